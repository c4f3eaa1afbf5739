"""From elements of a document to cleaned blocks and overlapping chunks.

Everything is an expression over arrays of one document, so no step needs a shuffle and a
document's state machine is a fold (aggregate) that runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lines, strip, word_count
from ..sources import scratch

# Fixed values of the chunker.
TARGET, LONGEST, OVERLAP = 1200, 2000, 200
WORDS_PER_PAGE, PAGES_UNCUT = 300, 4
BOILERPLATE_TIMES, BOILERPLATE_CHARS, HEADING_CHARS = 6, 80, 100
HEADING_WORDS = "ГЛАВА|РАЗДЕЛ|СТАТЬЯ|ПУНКТ"
BLOCK = "struct<type:string,level:int,text:string>"


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """The stripped parts of a text that are not empty, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), strip), lambda x: x != "")


def block(text: Column, metadata: Column | None = None) -> Column:
    """An element as struct(type, level, text). Headings are marked by their metadata, with the first
    number in it as level (6 at most, 1 without), or are short texts in capitals, with a number, or with a
    heading's word."""
    t = strip(text)
    capitals = (F.upper(t) == t) & (F.lower(t) != t)
    looks = (F.length(t) < HEADING_CHARS) & (capitals | t.rlike(r"(?U)^\d+\.?\s+[А-ЯA-Z]") | F.upper(t).rlike(HEADING_WORDS))
    meta = F.lit(None).cast("string") if metadata is None else F.lower(metadata)
    marked = F.coalesce(meta.rlike("heading|title"), F.lit(False))
    level = F.when(marked, F.coalesce(F.least(F.nullif(F.regexp_extract(meta, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(6)), F.lit(1))).when(looks, F.lit(1))
    return F.struct(F.when(marked | looks, "heading").otherwise("paragraph").alias("type"), level.alias("level"), t.alias("text"))


def blocks(elements: Column) -> Column:
    """The blocks of an array of element texts; nulls and empty ones are left out."""
    return F.transform(F.filter(elements, lambda x: x.isNotNull() & (x != "")), block)


def _with(b: Column, text: Column) -> Column:
    return F.struct(b["type"].alias("type"), b["level"].alias("level"), text.alias("text"))


def clean(found: Column) -> Column:
    """Blocks with white space tidied, without noise and without the lines that a document repeats often."""
    tidy = lambda t: F.regexp_replace(strip(F.regexp_replace(t, "[ \t]+", " ")), r"\n{3,}", "\n\n")
    tidied = F.transform(found, lambda b: _with(b, tidy(b["text"])))
    sound = F.filter(tidied, lambda b: (b["text"] != "") & ((b["type"] == "heading") | (F.length(b["text"]) > 2) | b["text"].rlike(r"(?U)\w")))

    def without_boilerplate(kept: Column) -> Column:
        def drop(all_lines: Column) -> Column:
            # lines in order: one that occurs often enough stands at two places so far apart in the sorted array
            often = F.array_distinct(F.filter(F.slice(all_lines, BOILERPLATE_TIMES, F.greatest(F.size(all_lines) - BOILERPLATE_TIMES + 1, F.lit(0))), lambda x: F.length(x) <= BOILERPLATE_CHARS))
            placed = F.filter(F.sequence(F.lit(1), F.greatest(F.size(all_lines) - BOILERPLATE_TIMES + 1, F.lit(1))), lambda i: F.get(all_lines, i - 1) == F.get(all_lines, i + BOILERPLATE_TIMES - 2))
            repeated = F.array_intersect(often, F.transform(placed, lambda i: F.get(all_lines, i - 1)))
            cut = lambda rep: F.transform(kept, lambda b: _with(b, strip(F.array_join(F.filter(lines(b["text"]), lambda x: ~F.array_contains(rep, x)), "\n"))))
            return F.filter(let(repeated, cut), lambda b: b["text"] != "")

        stripped = F.filter(F.flatten(F.transform(kept, lambda b: F.transform(lines(b["text"]), strip))), lambda x: x != "")
        return let(F.array_sort(stripped), drop)

    return let(sound, without_boilerplate)


def pages(found: Column) -> Column:
    """Pages by the number of words of the blocks, 1 at least."""
    words = F.aggregate(found, F.lit(0), lambda n, b: n + F.regexp_count(b["text"], F.lit(r"(?U)\w+")))
    return F.greatest(F.lit(1), F.ceil(words / WORDS_PER_PAGE)).cast("int")


def _state(buff: Column, path: Column, chunks: Column) -> Column:
    return F.struct(buff.alias("buff"), path.alias("path"), chunks.alias("chunks"))


def _flush(state: Column) -> Column:
    """The buffer as a chunk under the current path; its tail stays in the buffer."""

    def emit(text: Column) -> Column:
        chunk = F.struct(text.alias("text"), F.array_join(state["path"], " > ").alias("heading"))
        return _state(F.concat(F.when(F.length(text) > OVERLAP, F.right(text, F.lit(OVERLAP))).otherwise(text), F.lit("\n")), state["path"], F.concat(state["chunks"], F.array(chunk)))

    return F.when(state["buff"] == "", state).otherwise(let(strip(state["buff"]), emit))


def _fold(found: Column) -> Column:
    empty = _state(F.lit(""), F.array().cast("array<string>"), F.array().cast("array<struct<text:string,heading:string>>"))

    def take(state: Column, b: Column) -> Column:
        heading = b["type"] == "heading"
        piece = F.when(heading, F.concat(F.lit("\n# "), b["text"], F.lit("\n"))).otherwise(F.concat(b["text"], F.lit("\n")))
        level = F.coalesce(b["level"], F.lit(1))

        def headed(s: Column) -> Column:
            above = F.when(level <= F.size(s["path"]), F.slice(s["path"], F.lit(1), level - 1)).otherwise(s["path"])
            return F.when(heading, _state(s["buff"], F.concat(above, F.array(b["text"])), s["chunks"])).otherwise(s)

        steps = [
            lambda s: F.when(heading & (F.length(s["buff"]) >= TARGET // 2), _flush(s)).otherwise(s),
            headed,
            lambda s: F.when(F.length(s["buff"]) + F.length(piece) > LONGEST, _flush(s)).otherwise(s),
            lambda s: _state(F.concat(s["buff"], piece), s["path"], s["chunks"]),
            lambda s: F.when(F.length(s["buff"]) >= TARGET, _flush(s)).otherwise(s),
        ]
        for step in steps:
            state = let(state, step)
        return state

    return F.aggregate(found, empty, take, lambda s: let(s, _flush)["chunks"])


def chunk(found: Column) -> Column:
    """Chunks (array of struct(text, heading)) of cleaned blocks. Documents of few pages are one chunk; longer
    ones are cut near TARGET characters and before headings, each chunk beginning with the last one's tail."""
    whole = F.array(F.struct(F.array_join(F.transform(found, lambda b: b["text"]), "\n\n").alias("text"), F.lit("").alias("heading")))
    return F.when(pages(found) < PAGES_UNCUT, whole).otherwise(_fold(found))


def chunk_documents(docs: DataFrame, elements: Column, key: str = "doc_id") -> DataFrame:
    """One row per chunk: key, ord (from 0), chunk_id, heading, text, words. Documents without any element have none."""
    found = docs.select(key, blocks(elements).alias("b")).filter(F.size("b") > 0).select(key, clean(F.col("b")).alias("b"))
    rows = found.select(key, F.posexplode_outer(chunk(F.col("b"))).alias("ord", "c"))  # every document has a chunk
    return rows.select(
        key, "ord", F.concat(F.col(key).cast("string"), F.lit(":"), F.col("ord").cast("string")).alias("chunk_id"), F.col("c.heading").alias("heading"), F.col("c.text").alias("text"), word_count(F.col("c.text")).alias("words")
    )


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of each document, their mean size in tokens (a fourth of the characters), characters and words."""
    return chunks.groupBy(key).agg(
        F.count("*").alias("chunks"), F.round(F.avg(F.length("text")) / 4, 6).alias("avg_tokens"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum("words").cast("bigint").alias("words")
    )


def run_stats(stats: DataFrame, *by: str) -> DataFrame:
    """Of chunk_stats, for a run or for each value of some columns: files, chunks, and the mean of the files' mean chunk sizes."""
    return stats.groupBy(*by).agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.round(F.avg("avg_tokens"), 4).alias("avg_tokens"))


def full_text(chunks: DataFrame, key: str = "doc_id", separator: str = " ") -> DataFrame:
    """The chunks of each document in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"))


def offsets(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with template_id (the rank of the document) and vec_offset (chunks of all documents before it, and ord).

    Ranks and running totals are made on one row per document, in ranges of keys that are ranked apart; what lies
    before each range is a running total of one row per range. Chunks get theirs by a join. The bounds of the ranges are
    keys with the least hashes, as many as there are shuffle partitions: they decide on balance alone. chunks are
    computed once and written, as they are read for counts, bounds and the result.
    """
    path, schema = scratch.folder(chunks.sparkSession, "chunks"), chunks.schema
    chunks.write.parquet(path)
    chunks = chunks.sparkSession.read.schema(schema).parquet(path)
    n_ranges = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = chunks.select(key).distinct().orderBy(F.xxhash64(key), key).limit(n_ranges)
    bounds = drawn.agg(F.array_sort(F.collect_list(key)).alias("bounds"))
    part = F.size(F.filter("bounds", lambda b: b <= F.col(key)))
    per_doc = chunks.groupBy(key).agg(F.count("*").alias("n")).crossJoin(F.broadcast(bounds)).select(key, "n", part.alias("__range"))
    ranges = per_doc.groupBy("__range").agg(F.count("*").alias("docs"), F.sum("n").alias("rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = ranges.select("__range", so_far("docs").alias("docs"), so_far("rows").alias("rows"))
    by_key = Window.partitionBy("__range").orderBy(key)
    ranked = per_doc.withColumns({"rank": F.row_number().over(by_key), "above": F.sum("n").over(by_key) - F.col("n")})
    placed = ranked.join(F.broadcast(starts), "__range").select(key, (F.col("docs") + F.col("rank")).alias("template_id"), (F.col("rows") + F.col("above")).alias("first"))
    return chunks.join(placed, key).withColumn("vec_offset", F.col("first") + F.col("ord")).drop("first")
