"""Jaccard self-join of documents on their sets of word n-grams: MinHash banding, exact verification.

1. One pass over the texts gives each document a digest of its words and the hashes of
   its bands. Documents with the same words form a class; one representative goes on.
2. Representatives that share a band are linked to the least one in it (an aggregate and a
   join by the band's hash), and the components of those links are the candidate groups.
3. The n-gram sets of candidates only are made again from their texts and meet once per group.
   A group beyond a bound of n-grams is cut into parts, and each pair of parts is a task of its own.
4. A task verifies the pairs that share a band on the full sets and returns a row per document:
   its links, weighted by class sizes, and its root among the verified links. Pairs are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops, graph

#: N-grams and documents that one part of a group holds, about; a group of over SPLIT documents is cut
#: into up to SPREAD parts all the same, so that its pairs of parts are spread over many tasks.
PART_GRAMS, PART_DOCS, SPLIT, SPREAD = 200_000, 512, 112, 12
#: Documents compared at a time, and n-grams looked up at a time.
TILE, PROBES = 512, 250_000


def plan(threshold: float, recall: float, hashes: int = 224) -> tuple[int, int]:
    """(bands, rows): the longest rows for which pairs at the threshold are found with the wanted chance, within so many hashes."""
    best = (hashes, 1)
    for rows in range(1, 32):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1997)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(grams: np.ndarray, before: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of each text that has n-grams (texts x bands)."""
    mul, add = _coefficients(bands * rows)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(before) - 1, bands), np.uint64)
    buffer = np.empty_like(short)
    for k in range(bands * rows):
        np.multiply(short, mul[k], out=buffer)
        np.add(buffer, add[k], out=buffer)
        least = np.minimum.reduceat(buffer, before[:-1]).astype(np.uint64)
        band = k // rows
        out[:, band] = bytesops.mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k + 1))
    return out


def fingerprints(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), h1, h2 (a digest of the words; null without words), grams, bands; for each row of docs."""

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                words, cut = bytesops.word_hashes(data, offsets)
                grams, before = bytesops.shingles(words, cut, n)
                full = np.flatnonzero(np.diff(cut))
                h = bytesops.digests(bytesops.LOWER[data], offsets)
                lists = np.zeros((end - at, bands), np.uint64)
                if len(full):
                    starts = np.append(before[:-1][full], before[-1])
                    lists[full] = band_hashes(grams, starts, bands, rows)
                none = np.diff(cut) == 0
                bits = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1) * bands, pa.int32()), pa.array(lists.ravel().view(np.int64)))
                made = [pa.array(h[:, k], mask=none) for k in range(2)] + [pa.array(np.diff(before)), bits]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, end - at) for c in ("doc_id", "th")], *made], ["doc_id", "th", "h1", "h2", "grams", "bands"])

    source = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text")
    return source.mapInArrow(sign, "doc_id bigint, th bigint, h1 bigint, h2 bigint, grams bigint, bands array<bigint>")


def verified(rep: np.ndarray, size: np.ndarray, part: np.ndarray, grams: np.ndarray, cut: np.ndarray, bands: np.ndarray, threshold: float, across: bool) -> pa.RecordBatch | None:
    """The links among documents with distinct ids rep, sets grams[cut[i]:cut[i + 1]] (distinct in each)
    and band hashes: a row per linked document with its links and its root."""
    n = len(rep)
    order = np.argsort(bands[:, 0], kind="stable")  # like documents come to stand together
    name, coded = np.unique(grams, return_inverse=True)
    found_a, found_b = [], []
    length = np.diff(cut)
    for i in range(0, n, TILE):
        rows = order[i : i + TILE]
        for j in range(i, n, TILE):
            cols = order[j : j + TILE]
            near = np.zeros((len(rows), len(cols)), bool)
            for k in range(bands.shape[1]):
                near |= bands[rows, k][:, None] == bands[cols, k][None]
            small, large = np.minimum(length[rows][:, None], length[cols][None]), np.maximum(length[rows][:, None], length[cols][None])
            near &= small >= threshold * large
            if i == j:
                near &= np.triu(np.ones_like(near), 1)
            if across:
                near &= part[rows][:, None] != part[cols][None]
            a, b = np.nonzero(near)
            if len(a):
                a, b = rows[a], cols[b]
                both = shared(a, b, coded, cut, len(name))
                good = both >= threshold * (length[a] + length[b] - both) - 1e-9
                found_a.append(a[good])
                found_b.append(b[good])
    if not sum(map(len, found_a)):
        return None
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    links = np.bincount(a, size[b], n) + np.bincount(b, size[a], n)
    by_id = np.argsort(rep)
    place = np.empty_like(by_id)
    place[by_id] = np.arange(n)
    root = graph.local_roots(n, place[a], place[b])[place]
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[by_id][root[some]])], ["rep", "links", "root"])


def shared(a: np.ndarray, b: np.ndarray, coded: np.ndarray, cut: np.ndarray, names: int) -> np.ndarray:
    """The number of n-grams that the sets of each pair have in common: by look-up, or by products of incidence matrices if that is less work."""
    docs, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    length = np.diff(cut)[docs]
    flat = np.concatenate([coded[cut[d] : cut[d + 1]] for d in docs]).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), length)
    used, col = np.unique(flat, return_inverse=True)
    if len(docs) ** 2 * len(used) * 1e-10 < np.minimum(length[ia], length[ib]).sum() * 1e-7:
        often = np.bincount(col) > 1
        column = np.cumsum(often) - 1
        keep = often[col]
        owner, col, width = owner[keep], column[col[keep]], int(often.sum())
        total = np.zeros((len(docs), len(docs)), np.float32)
        by_col = np.argsort(col, kind="stable")
        owner, col = owner[by_col], col[by_col]
        for at in range(0, width, 4096):
            lo, hi = np.searchsorted(col, [at, at + 4096])
            m = np.zeros((len(docs), min(4096, width - at)), np.float32)
            m[owner[lo:hi], col[lo:hi] - at] = 1
            total += m @ m.T
        return total[ia, ib].round().astype(np.int64)
    out = np.zeros(len(a), np.int64)
    keys = np.sort(owner * names + flat)
    first = np.concatenate([[0], np.cumsum(length)])
    swap = length[ia] > length[ib]
    less, more = np.where(swap, ib, ia), np.where(swap, ia, ib)
    per = max(1, PROBES // max(1, int(length.max())))
    for at in range(0, len(a), per):
        x, y = less[at : at + per], more[at : at + per]
        pair = np.repeat(np.arange(len(x)), length[x])
        where = np.arange(len(pair)) - np.repeat(np.cumsum(length[x]) - length[x], length[x]) + first[:-1][x][pair]
        probe = y[pair] * names + flat[where]
        hit = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe
        out[at : at + per] = np.bincount(pair[hit], minlength=len(x))
    return out


def links(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, th, class_id, n_links, component_id, kept; one row for each row of docs (doc_id, text).

    Words are lower-cased runs of digits, letters and non-ASCII characters. class_id is the least id
    of the documents with the same words; n_links counts the other documents whose Jaccard
    similarity reaches the threshold, those of the class included; component_id is the least id that
    links reach; kept marks one row of that id, that of the least th. th is the hash of the text. A text of fewer than n words, but not
    none, has one n-gram; texts without words (null, empty) link with nothing, and so do rows
    without doc_id, whose class and component are null. Rows that repeat an id count each, whether
    their texts differ or not; rows that repeat id and text are all marked as kept if one is.
    """
    bands, rows = plan(threshold, recall)
    marked = graph.cut(fingerprints(docs, n, bands, rows))
    usable = F.col("h1").isNotNull() & F.col("doc_id").isNotNull()
    classes = marked.filter(usable).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("own"), F.count("*").alias("size"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = classes.select("h1", "h2", F.col("own.doc_id").alias("doc"), F.col("own.th").alias("th"), "size", "grams", "bands")
    classes = graph.cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # kept, so the numbers do not change
    spread = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    least = spread.groupBy("band", "bucket").agg(F.min("rep").alias("first"), F.count("*").alias("n")).filter("n > 1")
    candidate = spread.join(least.drop("n"), ["band", "bucket"]).filter("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    grouped = graph.connected_components(candidate).select(F.col("id").alias("rep"), F.col("component").alias("grp"))
    members = classes.join(grouped, "rep")
    count = F.count("*")
    need = F.greatest(F.ceil(F.sum("grams") / PART_GRAMS), F.ceil(count / PART_DOCS), F.least(F.ceil(count / SPLIT), F.lit(SPREAD)))
    parts = members.groupBy("grp").agg(need.cast("int").alias("np"))
    members = members.join(parts, "grp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("np")).cast("int"))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").withColumns({"th": F.xxhash64("text")})
    sets = text.join(members.select("doc", "th", "rep", "grp", "size", "np", "own", "bands"), ["doc", "th"])
    placed = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("other"))
    keys = ["grp", "low", "high"]
    placed = placed.select("grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "size", "bands", "text")

    def verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in graph.groups(source, keys):
            g = g.take(np.unique(g.column("rep").to_numpy(), return_index=True)[1])  # repeated rows
            rep, size, own = (g.column(c).to_numpy() for c in ("rep", "size", "own"))
            grams, cut = [], [0]
            for chunk in g.column("text").chunks:
                for _, _, data, offsets in bytesops.pieces(chunk):
                    words, before = bytesops.word_hashes(data, offsets)
                    found, at = bytesops.shingles(words, before, n)
                    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
                    order = np.lexsort([found, text_of])
                    found, text_of = found[order], text_of[order]
                    new = np.ones(len(found), bool)
                    new[1:] = (found[1:] != found[:-1]) | (text_of[1:] != text_of[:-1])
                    grams.append(found[new])
                    cut.extend((cut[-1] + np.cumsum(np.bincount(text_of[new], minlength=len(offsets) - 1))).tolist())
            signature = g.column("bands").combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
            across = g.column("low")[0].as_py() != g.column("high")[0].as_py()
            out = verified(rep, size, own, np.concatenate(grams), np.array(cut), signature, threshold, across)
            if out is not None:
                yield out

    linked = graph.cut(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "rep bigint, links bigint, root bigint"))
    components = graph.connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    own = classes.select("h1", "h2", "rep", "doc", F.col("th").alias("own_th"), "size")
    leader = components.join(own, "rep").groupBy("component").agg(F.min(F.struct("doc", "own_th")).alias("leader"))
    per_rep = linked.groupBy("rep").agg(F.sum("links").alias("links")).join(components, "rep").join(leader, "component").select("rep", "links", "leader")
    known = own.join(per_rep, "rep", "left").withColumn("leader", F.coalesce("leader", F.struct("doc", "own_th")))
    out = marked.select("doc_id", "th", F.when(usable, F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    return out.select(
        "doc_id",
        "th",
        F.coalesce("doc", "doc_id").alias("class_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("leader.doc", "doc_id").alias("component_id"),
        (F.col("leader").isNull() | F.col("leader").eqNullSafe(F.struct(F.col("doc_id").alias("doc"), F.col("th").alias("own_th")))).alias("kept"),
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs with one document of each group of linked ones, the one of least id (of least hash of the text, if several
    rows have it); all columns are kept. Rows that repeat id and text stay or go together."""
    gone = links(docs, n, threshold, recall).filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("bigint") == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left_anti")
