"""Part of gristmill; see the README for the layout."""
