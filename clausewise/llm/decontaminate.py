"""Benchmark decontamination with DataFrame functions only.

A text is lower-cased (A-Z) and cut into words. Every run of ``n`` consecutive
words of a benchmark item is a window; an item of fewer words, but not none, is
one shorter window. The windows' hashes are broadcast (behind a check of their
bytes, words and items included; beyond it they are joined by a shuffle), every window of every document is probed against them, and a hit counts
only when the words themselves are equal. Only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows, with their words and items, that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 128 << 20
#: What a row of a broadcast table and an item of an array take beside their values, about.
ROW_BYTES, ITEM_BYTES = 96, 16
#: Windows of each length that begin in one part of a text.
PART = 64


def words_of(text: Column) -> Column:
    """Lower-cased words; null and wordless texts have none. Letters outside A-Z keep their case."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), GAP), lambda w: w != "")


def windows_of(words: Column, n: int) -> Column:
    """The hash of each run of n words, in order of position (from 1)."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _probes(words: Column, n: int) -> Column:
    """The windows that begin in a part; the words behind its first PART are there to complete them."""
    return F.slice(F.transform(windows_of(words, n), lambda h, i: F.struct((i + 1).alias("pos"), F.lit(n).alias("len"), h.alias("h"))), 1, PART)


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """One row per distinct window: its hash ``h``, ``words`` joined by spaces, ``len``, and the items it occurs in."""
    words = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    sized = words.withColumn("len", F.least(F.size("w"), F.lit(n)))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
    run = sized.select("item", "len", F.explode(runs).alias("run"))
    return run.groupBy(F.xxhash64("run").alias("h"), F.array_join("run", " ").alias("words"), "len").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row of docs: n_words, spans (array of struct(pos, len), sorted) and items (sorted as strings).

    docs: doc_id, text, and any other columns, which are ignored. Rows that repeat a
    doc_id and a text each get the same result; null texts have no words. An empty
    benchmark, or one without words, hits nothing.
    """
    windows = item_windows(benchmark, n)
    named = F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x.cast("string")) + ITEM_BYTES)
    takes = F.octet_length("words") + named + ROW_BYTES
    per_len = {r["len"]: r["bytes"] for r in windows.groupBy("len").agg(F.sum(takes).alias("bytes")).collect()}  # n rows at most
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    head = F.when(F.col("part") == 0, F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("h"))))
    head = F.coalesce(head, F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))
    # every row of a window carries the words it is verified by, so texts are first cut into parts of PART windows
    longest = max(per_len, default=1)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(PART)), lambda i: F.slice("w", i, PART + longest - 1))
    base = base.select("doc_id", "th", F.size("w").alias("size"), F.posexplode(parts).alias("part", "w"))
    probes = [_probes(F.col("w"), size) for size in sorted(per_len)]
    # The row at pos 0 of the first part stands for the document itself and is never joined away.
    place = F.when(F.col("pos") > 0, F.col("part") * PART + F.col("pos")).otherwise(0).alias("pos")
    if sum(per_len.values()) <= BROADCAST_BYTES:
        probe = base.select("doc_id", "th", "size", "part", "w", F.explode(F.concat(head, *probes)).alias("p")).select("doc_id", "th", "size", "part", "w", "p.*")
        found = probe.join(F.broadcast(windows.withColumnRenamed("len", "wlen")), "h", "left")
        found = found.filter((F.col("pos") == 0) | (F.col("words") == F.array_join(F.slice("w", F.greatest("pos", F.lit(1)), F.col("len")), " ")))
        found = found.select("doc_id", "th", place, "len", "items", F.when(F.col("pos") == 0, F.col("size")).alias("n"))
    else:
        probe = base.select("doc_id", "th", "part", F.explode(F.concat(*probes)).alias("p")).select("doc_id", "th", "part", "p.*")
        near = probe.join(windows.select("h", "words", "items"), "h")
        exact = near.join(base.dropDuplicates(["doc_id", "th", "part"]), [near["doc_id"].eqNullSafe(base["doc_id"]), near["th"] == base["th"], near["part"] == base["part"]]).filter(
            F.col("words") == F.array_join(F.slice("w", F.col("pos"), F.col("len")), " ")
        )
        exact = exact.select(near["doc_id"], near["th"], (near["part"] * PART + F.col("pos")).alias("pos"), "len", "items", F.lit(None).cast("int").alias("n"))
        own = base.filter("part = 0").select("doc_id", "th", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast(exact.schema["items"].dataType).alias("items"), F.col("size").alias("n"))
        found = own.unionByName(exact)
    per_doc = found.groupBy("doc_id", "th").agg(
        F.count("n").alias("copies"),
        F.first("n", ignorenulls=True).alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string")))).alias("items"),
    )
    one = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return one.drop("copies", "copy")


def hit_words(spans: Column) -> Column:
    """The number of words inside any span; spans are sorted."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["pos"] + s["len"] - F.greatest(s["pos"], a["upto"]), F.lit(0)).cast("bigint")).alias("n"),
        F.greatest(a["upto"], s["pos"] + s["len"]).alias("upto"),
    )
    return F.aggregate(spans, start, step)["n"]


def decontamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs."""
    found = hits(docs, benchmark, n)
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without the contaminated documents (``remove="documents"``), or with the hit words cut
    out of their texts (``remove="spans"``: the other words, lower-cased, joined by spaces; untouched
    texts stay as they are). All columns of docs are kept; only the keys of hit documents are shuffled
    to the join, which is a broadcast as long as they are few."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    found = hits(docs, benchmark, n).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])
    bad = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    same = [docs["doc_id"].eqNullSafe(bad["__id"]), F.xxhash64(docs["text"]) == bad["__th"]]
    if remove == "documents":
        return docs.join(bad.drop("__spans"), same, "left_anti")
    kept = F.filter(words_of(F.col("text")), lambda w, i: ~F.exists("__spans", lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["len"])))
    out = docs.join(bad, same, "left")
    return out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)
), h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
