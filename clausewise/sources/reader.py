"""The elements of document files as a source of their own: spark.read.format(NAME).load(path), or readStream.

Partitions are planned by file size; equality filters on suffix and category are pushed down to the
list of files, so files that are not wanted are not opened. Files are reached by pyarrow's file
systems; for stores that only Spark's readers reach there is files.read_elements.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

from . import files

NAME = "document_elements"
#: Bytes of files that a partition has; a larger file is one of its own. Rows of a batch.
PARTITION_BYTES, ROWS = 32 << 20, 4096


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ElementsSource)


def _described(path: str) -> dict:
    folder, name = posixpath.split(path)
    stem, dot, suffix = name.rpartition(".")
    return {"doc_path": path, "doc_id": stem if dot else name, "category": posixpath.basename(folder), "source_type": suffix.lower() if dot else ""}


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths  # as the file system has them, and as rows show them


class _Reader:
    def __init__(self, options: Mapping[str, str], path: str):
        self.root = path
        self.formats = tuple(f.strip() for f in options.get("formats", ",".join(files.FORMATS)).split(","))
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def listed(self) -> list[tuple[int, int, str, str]]:
        """Time, size and both paths of the files, in order of time and path."""
        system, place = fs.FileSystem.from_uri(self.root if "://" in self.root else posixpath.abspath(self.root.removeprefix("file:")))
        local = isinstance(system, fs.LocalFileSystem)
        start = "file:" if local else self.root[: self.root.index("://") + 3]
        found = []
        for f in system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)):
            hidden = any(x.startswith(("_", ".")) and "=" not in x for x in f.path.removeprefix(place).split("/"))
            if f.type == fs.FileType.File and not hidden and f.extension in self.formats:
                row = _described(start + f.path)
                if all(row[c] in values for c, values in self.wanted.items()):
                    found.append((f.mtime_ns or 0, f.size, f.path, row["doc_path"]))
        return sorted(found, key=lambda x: (x[0], x[3]))

    def dealt(self, found: list[tuple[int, int, str, str]]) -> list[Files]:
        out, held = [], 0
        for _, size, path, shown in sorted(found, key=lambda x: x[3]):
            if not out or held + size > self.most:
                out.append([])
                held = 0
            out[-1].append((path, shown))
            held += size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.root if "://" in self.root else "/")[0]
        rows: list[dict] = []
        for path, shown in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            row = {"doc_key": hashlib.sha256(shown.encode() + content).hexdigest()} | _described(shown)
            rows += files.parsed(row, content, files.PARSERS.get(row["source_type"], _text))
            while len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows[:ROWS], schema=files.SCHEMA)
                rows = rows[ROWS:]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=files.SCHEMA)


def _text(content: bytes) -> list[dict]:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("cp1251")
    return [{"element_type": "paragraph", "text": p.strip()} for p in text.split("\n\n") if p.strip()]


class ElementsReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equality and lists of values of category and source_type, which are never null; yields back all others."""
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("category",), ("source_type",)):
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("category", "source_type"):
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())


class ElementsStreamReader(_Reader, DataSourceStreamReader):
    """Files by time of change: a batch has those that changed after the last one's newest. A file that is put in place
    later must not be older than files that were read before, as moving keeps the time of writing."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": max((f[0] for f in self.listed()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt([f for f in self.listed() if start["until"] < f[0] <= end["until"]])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class ElementsSource(DataSource):
    """Options: formats (suffixes, parted by commas), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return files.ELEMENTS

    def reader(self, schema) -> ElementsReader:
        return ElementsReader(self.options, self.options["path"])

    def streamReader(self, schema) -> ElementsStreamReader:  # noqa: N802
        return ElementsStreamReader(self.options, self.options["path"])
