"""Documents in files: a recursive scan of text and office files into one row per element.

Files are read by Spark's binaryFile source. Text is decoded and cut by expressions; other formats
are parsed by functions from bytes to elements, which a caller may add to (PARSERS). A file that
cannot be parsed gives one row with parse_error instead of ending the job.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text_files

FORMATS = ("txt", "pdf", "docx")
ELEMENTS = (
    "doc_key string, doc_path string, doc_id string, category string, source_type string, page int, `order` int, element_type string, text string, html string, "
    "bbox array<double>, media_path string, metadata map<string,string>, parse_error string"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


def _runs(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _rows(body: ElementTree.Element, separator: str) -> Iterator[str]:
    for table in body.findall(_W + "tbl"):  # those inside cells are not tables of their own
        for row in table.findall(_W + "tr"):
            cells = ["\n".join(_runs(p) for p in cell.findall(_W + "p")) for cell in row.findall(_W + "tc")]
            yield separator.join(c.replace("\n", " ").strip() for c in cells)


def _body(content: bytes) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")


def parse_docx(content: bytes) -> list[dict]:
    """Paragraphs that are not empty, then the rows of all tables (cells parted by tabs), then formulas as html."""
    body = _body(content)
    out = [{"element_type": "paragraph", "text": t} for p in body.findall(_W + "p") if (t := _runs(p).strip())]
    out += [{"element_type": "table", "text": row} for row in _rows(body, "\t")]
    return out + [{"element_type": "formula", "html": ElementTree.tostring(m, encoding="unicode")} for m in body.iter(_M + "oMath")]


def parse_docx_headings(content: bytes) -> list[dict]:
    """In order of the document, with heading levels from paragraph styles; a table is one element of lines."""
    out = []
    for node in _body(content):
        if node.tag == _W + "p" and (text := _runs(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else style.get(_W + "val", "")
            digits = "".join(c for c in name if c.isdigit())
            if name.lower().startswith(("heading", "заголовок")):
                out.append({"element_type": "heading", "text": text, "metadata": {"heading": digits or "1"}})
            else:
                out.append({"element_type": "paragraph", "text": text})
        elif node.tag == _W + "tbl":
            rows = [" | ".join(_runs(c).replace("\n", " ").strip() for c in r.findall(_W + "tc")) for r in node.findall(_W + "tr")]
            out.append({"element_type": "table", "text": "\n".join(rows)})
    return out


def parse_pdf(content: bytes) -> list[dict]:
    raise ValueError("no PDF reader is installed; pass one in parsers")


#: Any other suffix is taken for text.
PARSERS: dict[str, Callable[[bytes], list[dict]]] = {"docx": parse_docx, "pdf": parse_pdf}
SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("doc_key", "doc_path", "doc_id", "category", "source_type")]
    + [("page", pa.int32()), ("order", pa.int32()), ("element_type", pa.string()), ("text", pa.string()), ("html", pa.string()), ("bbox", pa.list_(pa.float64())), ("media_path", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("parse_error", pa.string())]
)


def described(files: DataFrame) -> DataFrame:
    """doc_key (of path and content), doc_path, doc_id, category (the folder), source_type (the suffix) and content of files."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.sha2(F.concat(F.col("path").cast("binary"), F.col("content")), 256).alias("doc_key"),
        F.col("path").alias("doc_path"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"),
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("category"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("source_type"),
        "content",
    )


def parsed(row: dict, content: bytes, parser: Callable[[bytes], list[dict]]) -> list[dict]:
    """The elements of a file as rows of SCHEMA, or one row with what went wrong."""
    try:
        found, error = parser(content), None
    except Exception as e:  # whatever a broken file makes a parser do
        found, error = [{}], f"{type(e).__name__}: {e}"
    return [row | {"order": k, "parse_error": error} | e for k, e in enumerate(found)]


def _by_parsers(rows: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]]) -> DataFrame:
    def parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in SCHEMA.names[:5]}
                if out := parsed(row, b.column("content")[k].as_py(), parsers[row["source_type"]]):
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return rows.mapInArrow(parse, ELEMENTS)


def _by_text(rows: DataFrame) -> DataFrame:
    read = rows.withColumn("read", text_files.decoded(F.col("content"))).drop("content")
    each = read.select("*", F.posexplode(F.when(F.col("read.error").isNull(), text_files.parts(F.col("read.text"))).otherwise(F.array(F.lit(None).cast("string")))).alias("order", "text"))
    kind = F.when(F.col("read.error").isNull(), "paragraph")
    own = {"element_type": kind, "text": F.col("text"), "order": F.col("order"), "parse_error": F.col("read.error")}
    return each.select(*[own.get(n, F.col(n) if n in SCHEMA.names[:5] else F.lit(None)).cast(t).alias(n) for n, t in _types()])


def _types() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ELEMENTS)]


def elements(files: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]] = PARSERS, formats: tuple[str, ...] | None = None) -> DataFrame:
    """One row per element of files that are at hand as path and content. formats names the suffixes that there are, if
    they are known: without text, or without anything else, only one of the two ways is planned."""
    rows = described(files)
    other = [f for f in (formats or parsers) if f in parsers]
    if formats is not None and not other:
        return _by_text(rows)
    made = _by_parsers(rows.filter(F.col("source_type").isin(other)), parsers)
    return made if formats is not None and len(other) == len(formats) else made.unionByName(_by_text(rows.filter(~F.col("source_type").isin(other))))


def documents(files: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]] = PARSERS, formats: tuple[str, ...] | None = None) -> DataFrame:
    """One row per file, in one pass: doc_key, doc_path, doc_id, category, source_type, text (of all elements, by lines), parse_error."""
    rows = described(files)
    names = ["doc_key", "doc_path", "doc_id", "category", "source_type", "text", "parse_error"]
    read = text_files.decoded(F.col("content"))
    plain = rows.withColumn("read", read).select(*names[:5], "read.text", F.col("read.error").alias("parse_error"))
    other = [f for f in (formats or parsers) if f in parsers]
    if not other:
        return plain

    def parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in names[:5]}
                out = parsed(row, b.column("content")[k].as_py(), parsers[row["source_type"]])
                error = out[0]["parse_error"] if out else None
                yield pa.RecordBatch.from_pylist([row | {"text": None if error else "\n".join(e.get("text") or "" for e in out), "parse_error": error}], schema=schema)

    schema = pa.schema([(n, pa.string()) for n in names])
    made = rows.filter(F.col("source_type").isin(other)).mapInArrow(parse, ", ".join(f"{n} string" for n in names))
    return made.unionByName(plain.filter(~F.col("source_type").isin(other)))


def _source(reader, formats: tuple[str, ...]):
    return reader.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(formats) + "}")


def _each_way(load: Callable[[tuple[str, ...]], DataFrame], formats: tuple[str, ...], parsers: dict) -> DataFrame:
    """Text files and others are listed apart, so that neither are read to be left out."""
    ways = [w for w in (tuple(f for f in formats if f in parsers), tuple(f for f in formats if f not in parsers)) if w]
    return functools.reduce(DataFrame.unionByName, [elements(load(w), parsers, w) for w in ways])


def read_elements(spark: SparkSession, path: str, formats: tuple[str, ...] = FORMATS, parsers: dict | None = None) -> DataFrame:
    """One row per element of the files under path with one of the suffixes (as they are written). No files, no rows."""
    return _each_way(lambda some: _source(spark.read, some).load(path), formats, PARSERS | (parsers or {}))


def stream_elements(spark: SparkSession, path: str, formats: tuple[str, ...] = FORMATS, parsers: dict | None = None) -> DataFrame:
    """read_elements as a stream: each file once, when it first appears."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _each_way(lambda some: _source(spark.readStream, some).schema(schema).load(path), formats, PARSERS | (parsers or {}))
