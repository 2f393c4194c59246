"""gristmill: document retrieval, graph and corpus processing on Spark DataFrames."""
