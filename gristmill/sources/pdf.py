"""A Python data source for PDF pages: one partition a file; the parser is pluggable, as no PDF library is assumed."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page_number int, block_index int, x0 double, y0 double, x1 double, y1 double, text string, avg_font_size double"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local, or one that pyarrow knows by its scheme) and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class PdfBlocks(DataSource):
    """spark.read.format("pdf_blocks").option("parser", "module:function").load(folder); the function gives block dictionaries from a file's bytes."""

    @classmethod
    def name(cls) -> str:
        return "pdf_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parser = options["path"], options.get("parser")

    def partitions(self) -> list[InputPartition]:
        system, where = located(self.path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.File:
            return [InputPartition(self.path)]
        found = system.get_file_info(fs.FileSelector(where, recursive=True))
        scheme = self.path.partition(":/")[0] + "://" if ":/" in self.path else ""
        return [InputPartition(scheme + x.path if scheme else x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.lower().endswith(".pdf")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.parser:
            raise ValueError("option parser (module:function) is needed")
        module, _, function = self.parser.partition(":")
        system, where = located(partition.value)
        with system.open_input_stream(where) as f:
            data = f.read()
        for b in getattr(importlib.import_module(module), function)(data):
            yield (partition.value, b["page_number"], b["block_index"], *(float(b[c]) for c in ("x0", "y0", "x1", "y1")), b["text"], b.get("avg_font_size"))
