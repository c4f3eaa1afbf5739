"""How far the vocabularies of sources of a language lie apart, term by term and in exact whole numbers.

A smoothed share is given to every kept term of a language in every group (language, source), also to
those that the group never uses, so the divergence of two sources is a sum over all kept terms. It is
not computed term by term. A term that only one side uses costs what its count costs, so the
histogram of a group's counts prices those at once; terms that neither uses cost a constant; and
only terms that both use are corrected one by one, by joining the postings of a term:

    sum = V * f00 + sum over counts c of a of terms(c) * (f(c, 0) - f00) + the same for b
          + sum over shared terms of (f(ca, cb) - f(ca, 0) - f(0, cb) + f00)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops, graph

#: Counts that a task holds before it sends them, and bytes of a text that are cut into words at once.
HELD, PART = 200_000, 1 << 20
#: Rows of groups that are broadcast; more of them are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: What is not a letter of A-Z or beyond ASCII parts words; A-Z are lower-cased.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PART
        part = text[at:end].translate(_LOWER)
        # a part begins with the blank that ended the one before, which must not end it again
        if end < len(text) and (cut := part.rfind(b" ", 1)) >= 0:
            part, end = part[:cut], at + cut
        elif end < len(text):  # a word longer than a part
            rest = text[at:].translate(_LOWER)
            end = at + (cut if (cut := rest.find(b" ", 1)) >= 0 else len(rest))
            part = rest[: end - at]
        yield part.split()
        at = end


def _counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of the tasks; a row without a term says that the group occurs."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, src), (n, docs) in groups.items():
                words = [None, *n]
                arrays = [pa.array([lang] * len(words)), pa.array([src] * len(words)), pa.array([w and w.decode() for w in words], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[w] for w in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for b in bytesops.batches(source):
            for lang, src, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, docs = groups.setdefault((lang, src), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in terms(text or b""):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n) - before
                if held >= HELD:
                    yield from flush()
                    groups, held = {}, 0
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def _share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 2) / total), exact for counts of any size."""
    exact = "decimal(38,0)"
    return (F.lit(1) + F.call_function("div", F.lit(scale).cast(exact) * (n + 2).cast(exact), total.cast(exact))).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares that are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, scale: int = 1_000_000_000, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank.

    docs: text, lang, source; null counts as '' in each, other columns are ignored, and rows that repeat count as often
    as they are there. Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. A language keeps the
    terms that at least min_docs of its documents have. For each source of a language, part 'pair' has a row for each
    other source of it, with the summed distance over all kept terms (0 without such), and part 'term' the top terms
    that the source uses more than its language does. Ranks follow value, then item in order of its UTF-8 bytes. Long
    texts are read whole, in parts. An empty table gives no rows; one source alone has no pairs.
    """
    dealt = _counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = dealt.withColumns({"total": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = graph.table(summed.filter(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"))
    is_term = F.col("term").isNotNull()
    langs = kept.groupBy("lang").agg(F.count_if(is_term & F.col("first")).alias("v"), F.sum("n").alias("all"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own")).join(langs, "lang")
    smooth = lambda n: F.col(n) + 2 * F.col("v")
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.greatest(smooth("own"), F.lit(1)), scale))
    groups = graph.cut(groups.withColumns({"own": smooth("own"), "all": smooth("all"), "zero": zero}))
    small = groups.count() <= BROADCAST_GROUPS  # rows of two names and four numbers
    sides = F.broadcast(groups) if small else groups

    postings = kept.filter(is_term).join(sides, ["lang", "source"]).select("lang", "term", "source", "n", _share(F.col("n"), F.col("own"), scale).alias("p"), "zero", "total", "all")
    pairs = _pairs(postings, groups, sides)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    usual = _share(F.col("total"), F.col("all"), scale)
    more = postings.withColumn("q", usual).filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(both, "pair").unionByName(ranked(more, "term").filter(F.col("rank") <= top))


def _pairs(postings: DataFrame, groups: DataFrame, sides: DataFrame) -> DataFrame:
    """lang, a, b (a before b), value: what every two sources of a language have between them, shared terms or not."""
    left = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v")
    right = sides.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    none = distance(F.col("za"), F.col("zb"))
    base = left.join(right, "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * none, F.lit(0)).alias("value"))

    counts = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    one = counts.select("lang", F.col("source").alias("a"), "p", F.col("zero").alias("za"), "terms").join(right, "lang").filter("a <> b")
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("terms") * (distance(F.col("p"), F.col("zb")) - none)).alias("value"))

    of = lambda s: postings.select("lang", "term", F.col("source").alias(s), F.col("p").alias("p" + s), F.col("zero").alias("z" + s))
    shared = of("a").join(of("b"), ["lang", "term"]).filter("a < b")
    change = distance(F.col("pa"), F.col("pb")) - distance(F.col("pa"), F.col("zb")) - distance(F.col("za"), F.col("pb")) + none
    shared = shared.groupBy("lang", "a", "b").agg(F.sum(change).alias("value"))
    return base.unionByName(one).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
full_ AS (SELECT g.lang, g.source, kept.term, total, coalesce(n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (total + 2)) // (sum(total) OVER s + 2 * count(*) OVER s)::HUGEINT AS q
  FROM full_ WINDOW s AS (PARTITION BY lang, source)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3
), pair AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
), term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL BY NAME SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term
) WHERE part = 'pair' OR rank <= 10
"""
