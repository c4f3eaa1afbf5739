"""Licences of documents: TF-IDF cosine of lines, runs of lines and whole texts to licence notices, and inheritance along paths.

Terms are lower-cased words; their document frequencies are counted over all documents. A line,
or run of lines, whose cosine to a template reaches the threshold is a notice of that licence for its
own document. A document whose whole text is near a notice or a complete licence text is a licence
file: it declares the licence of its directory, which documents without a notice inherit from the nearest ancestor directory that declares one.

The frequencies of all words are never in one place. A first pass finds the runs and texts that
could reach a threshold if every word of no template had the least weight there is; only the words
of these candidates are joined to their frequencies, once for each block of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops, graph

#: Notices by SPDX identifier, as projects put them in headers and licence files.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: A task hands on its counts of words when it holds half as many words as this.
MERGE_TERMS = 1 << 21
#: About so many words of segments are scored at a time.
SCORED_WORDS = 1 << 18


class Scorer:
    """Cosines of segments (runs of words) of texts to the templates."""

    def __init__(self, templates: dict[str, list[str]], files: dict[str, list[str]]):
        given = [(name, complete, t) for complete, kind in ((False, templates), (True, files)) for name, texts in kind.items() for t in texts]
        given.sort(key=lambda x: x[:2])
        self.names = [name for name, _, _ in given]
        self.complete = np.array([complete for _, complete, _ in given], bool)
        self.texts = [t for _, _, t in given]
        words = [bytesops.word_hashes(*bytesops.column_bytes(pa.array([t])))[0] for t in self.texts]
        self.terms = np.unique(np.concatenate(words))
        self.counts = np.zeros((len(self.terms), len(words)))
        for k, w in enumerate(words):
            np.add.at(self.counts[:, k], np.searchsorted(self.terms, w), 1)

    def term_of(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, or the number of terms for words of no template."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, len(self.terms))

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        """frequency: of the templates' terms. The last of idf is the least that any word can have."""
        self.documents = documents
        self.idf = np.append(self.idf_of(frequency), 1.0)
        self.unit = self.counts * self.idf[:-1, None]
        self.unit /= np.sqrt((self.unit**2).sum(0))
        self.part = np.vstack([self.unit * self.idf[:-1, None], np.zeros(self.unit.shape[1])])

    def idf_of(self, frequency: np.ndarray) -> np.ndarray:
        return np.log((1 + self.documents) / (1 + frequency)) + 1

    def markers(self, threshold: np.ndarray) -> np.ndarray:
        """By term: whether it is one of those without which no segment can reach its template's threshold.

        The squares of the template's shares of the words in common add up to the cosine's square at least,
        so any words will do whose others fall short of that: the rarest ones.
        """
        order = np.argsort(-self.idf[:-1], kind="stable")
        square = self.unit[order] ** 2
        before = np.cumsum(square, axis=0) - square
        out = np.zeros(len(self.idf), bool)
        out[order] = ((square > 0) & (before <= 1 - (threshold - 1e-6) ** 2 + 1e-9)).any(1)
        return out

    def cosines(self, segment: np.ndarray, terms: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
        """n x templates, of segments given by their distinct words in order of the segments."""
        norm = np.sqrt(np.bincount(segment, (count * idf) ** 2, n))
        dot = np.zeros((n, len(self.names)))
        some = np.flatnonzero(terms < len(self.terms))
        if len(some):
            own = segment[some]
            cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for lo, hi in _chunks(np.diff(np.append(cut, len(some)))):
                mine = some[cut[lo] : cut[hi] if hi < len(cut) else None]
                dot[own[cut[lo:hi]]] = np.add.reduceat(self.part[terms[mine]] * count[mine, None], cut[lo:hi] - cut[lo], axis=0)
        return dot / np.maximum(norm, 1e-300)[:, None]


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive items of about SCORED_WORDS in all; a larger one is alone."""
    at, end = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SCORED_WORDS, "right")))
        yield at, to
        at = to


def condense(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, word, count) of the distinct words of the segments [start, stop)."""
    size = stop - start
    segment = np.repeat(np.arange(len(size)), size)
    word = words[np.arange(len(segment)) + np.repeat(start - np.cumsum(size) + size, size)]
    order = np.lexsort([word, segment])
    segment, word = segment[order], word[order]
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (segment[1:] != segment[:-1])))[: len(word)]
    return segment[new], word[new], np.diff(np.append(new, len(word)))


def complete_texts() -> dict[str, list[str]]:
    """Complete licence texts by SPDX identifier, beside this module; those of other versions keep their like apart."""
    folder = resources.files(__package__) / "licences"
    return {f.name.removesuffix(".txt"): [f.read_text(encoding="utf-8")] for f in folder.iterdir() if f.name.endswith(".txt")}


def _frequencies(docs: DataFrame) -> DataFrame:
    """term, n: the number of documents that hold each word, and of all documents at a null term."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        term, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return term, np.bincount(at, np.concatenate([p[1] for p in parts]), len(term)).astype(np.int64)

    def batch(term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rows = [], 0, 0
        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                words, before = bytesops.word_hashes(data, offsets)
                text = np.repeat(np.arange(end - at), np.diff(before))
                order = np.argsort(words, kind="stable")
                word, text = words[order], text[order]
                word = word[np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))[: len(word)]]
                parts.append(np.unique(word, return_counts=True))
                held += len(parts[-1][0])
                rows += end - at
                if held > MERGE_TERMS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > MERGE_TERMS // 2:
                        yield batch(*parts[0])
                        parts, held = [], 0
        if parts:
            yield batch(*merged(parts))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


#: The columns that a scan adds.
MADE = {"notice": T.StringType(), "notice_score": T.DoubleType(), "notice_line": T.LongType(), "file_licence": T.StringType(), "file_score": T.DoubleType()}


def scan(docs: DataFrame, threshold: float = 0.7, file_threshold: float = 0.5, templates: dict[str, list[str]] | None = None, complete_threshold: float = 0.85, files: dict[str, list[str]] | None = None) -> DataFrame:
    """docs without text, with notice, notice_score, notice_line (of the best run of lines its first, from 0; nulls if
    no run reaches threshold), file_licence and file_score (of the whole text, from file_threshold on
    for notices and from complete_threshold on for complete texts, which share many words with other prose).

    Every line, every run of consecutive lines (those without words do not count) whose lines before the last
    have fewer words than the longest template, and every whole text is scored. Of equal scores the first licence
    by name, then the first line and then the shortest run wins. files: the complete texts, those of
    complete_texts() unless templates are given. Null and empty texts have no licence. Columns with these names are replaced.
    """
    docs, back = graph.aside(docs.select(*[f"`{c}`" for c in docs.columns if c not in MADE]), ("text",))
    scorer = Scorer(TEMPLATES if templates is None else templates, files if files is not None else complete_texts() if templates is None else {})
    frequency = graph.cut(_frequencies(docs))
    own = docs.sparkSession.createDataFrame(pa.table({"term": scorer.terms.view(np.int64)}))
    counted = {r["term"]: r["n"] for r in frequency.join(F.broadcast(own), "term").collect()}  # a row per term of the templates
    documents = [r["n"] for r in frequency.filter("term IS NULL").collect()]  # one row
    scorer.weigh(sum(documents), np.array([counted.get(int(x), 0) for x in scorer.terms.view(np.int64)]))
    line_bar, text_bar = np.where(scorer.complete, np.inf, threshold), np.where(scorer.complete, complete_threshold, file_threshold)
    line_marker, text_marker = scorer.markers(line_bar), scorer.markers(text_bar)
    made = list(MADE.items())
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(*m) for m in made])
    lists = ["__line", "__segment", "__term", "__count"]  # the first line of each segment, or -1 for the text; the others by distinct word
    found_schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__block", T.StringType())] + [T.StructField(c, T.ArrayType(T.LongType())) for c in lists])
    names = np.array([*scorer.names, None], object)

    def hopeful(words: np.ndarray, start: np.ndarray, stop: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The segments that may reach bar, and the distinct words of them all."""
        parts, found = [(np.zeros(0, np.int64),) * 4], 0
        for lo, hi in _chunks(stop - start):
            segment, word, count = condense(words, start[lo:hi], stop[lo:hi])
            terms = scorer.term_of(word)
            able = (scorer.cosines(segment, terms, count, scorer.idf[terms], hi - lo) >= bar - 1e-9).any(1)
            mine = able[segment]
            parts.append((np.flatnonzero(able) + lo, (np.cumsum(able) - 1)[segment[mine]] + found, word[mine].view(np.int64), count[mine]))
            found += able.sum()
        which, segment, word, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
        return which, (segment, word.view(np.uint64), count)

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                n = end - at
                low = bytesops.LOWER[data]
                start, stop, before = bytesops.word_spans(low, offsets)
                words = bytesops.word_hash(low, start, stop)
                terms = scorer.term_of(words)
                text = np.repeat(np.arange(n), np.diff(before))
                feeds = np.concatenate([[0], np.cumsum(data == 10)])
                line = feeds[start] - feeds[offsets[:-1]][text]
                first, last = _runs(text, line, terms, scorer, line_marker, line_bar)
                lines, of_lines = hopeful(words, first, last, line_bar)
                marked = np.flatnonzero(np.bincount(text, text_marker[terms], n))
                texts, of_texts = hopeful(words, before[marked], before[marked + 1], text_bar)
                owner = np.concatenate([text[first[lines]], marked[texts]]).astype(np.int64)
                where = np.concatenate([line[first[lines]], np.full(len(texts), -1)]).astype(np.int64)
                segment = np.concatenate([of_lines[0], of_texts[0] + len(lines)]).astype(np.int64)
                word, count = (np.concatenate([of_lines[k], of_texts[k]]) for k in (1, 2))
                rank = np.argsort(owner, kind="stable")
                inverse = np.empty_like(rank)
                inverse[rank] = np.arange(len(rank))
                order = np.argsort(inverse[segment], kind="stable")
                per = np.bincount(owner, minlength=n)
                entries = np.bincount(owner[segment], minlength=n)
                inner = inverse[segment][order] - np.repeat(np.cumsum(per) - per, entries)
                by_segment, by_word = (pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()) for k in (per, entries))
                values = [where[rank], inner, word[order].view(np.int64), count[order].astype(np.int64)]
                arrays = [pa.ListArray.from_arrays(by_segment if k == 0 else by_word, pa.array(v)) for k, v in enumerate(values)]
                block = pa.array(np.where(per > 0, uuid.uuid4().hex, None), pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, n) for c in keep], block, *arrays], [*keep, "__block", *lists])

    def score(docs: pa.Table, counted: pa.Table) -> pa.Table:
        flat = {c: docs.column(c).combine_chunks() for c in lists}
        per, entries = (np.diff(flat[c].offsets.to_numpy()) for c in ("__line", "__term"))
        where, inner, word, count = (flat[c].flatten().to_numpy() for c in lists)
        n, owner = len(per), np.repeat(np.arange(len(per)), per)
        segment = inner + np.repeat(np.cumsum(per) - per, entries)
        terms = scorer.term_of(word.view(np.uint64))
        idf = scorer.idf[terms]
        other = terms == len(scorer.terms)
        known, frequency = counted.column("term").to_numpy(), counted.column("n").to_numpy()
        order = np.argsort(known)
        idf[other] = scorer.idf_of(frequency[order][np.searchsorted(known[order], word[other])])
        value = np.round(scorer.cosines(segment, terms, count, idf, len(owner)), 9)
        out = []
        for mine, bar in ((np.flatnonzero(where >= 0), line_bar), (np.flatnonzero(where < 0), text_bar)):
            able = np.where(value[mine] >= bar - 1e-9, value[mine], -1)
            template = able.argmax(1)
            cosine = able[np.arange(len(mine)), template]
            good = cosine >= 0
            mine, template, cosine = mine[good], template[good], cosine[good]
            rank = np.lexsort([mine, template, -cosine, owner[mine]])
            top = rank[np.append(True, owner[mine][rank][1:] != owner[mine][rank][:-1])[: len(rank)]]
            pick, best, line = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            pick[owner[mine][top]], best[owner[mine][top]], line[owner[mine][top]] = template[top], np.minimum(cosine[top], 1), where[mine][top]
            out += [pa.array(names[pick], pa.string()), pa.array(best, mask=pick < 0), pa.array(line, mask=pick < 0)]
        return pa.Table.from_arrays([*[docs.column(c) for c in keep], *out[:5]], [*keep, *dict(made)])

    found = graph.cut(docs.select(*keep, "text").mapInArrow(find, found_schema))
    some = found.filter("__block IS NOT NULL")
    needed = some.select(F.col("__block").alias("__of"), F.explode(F.array_distinct("__term")).alias("term")).distinct()
    scored = some.groupBy("__block").cogroup(needed.join(frequency, "term").groupBy("__of")).applyInArrow(score, schema)
    plain = found.filter("__block IS NULL").select(*keep, *[F.lit(None).cast(kind).alias(c) for c, kind in made])
    return back(plain.unionByName(scored))


def _runs(text: np.ndarray, line: np.ndarray, terms: np.ndarray, scorer: Scorer, marker: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each run of lines that may reach bar, and the one after the last, by first line and length.

    A run grows while it has fewer words than the longest template with a bar. One that begins or ends with a line
    without a word of a template is left to the shorter run, which scores higher.
    """
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])))[: len(line)]
    last = np.append(first[1:], len(line))
    most = scorer.counts[:, bar <= 1].sum(0).max(initial=0)
    marks = np.concatenate([[0], np.cumsum(marker[terms])])
    holds = _sums(terms < len(scorer.terms), first, last) > 0
    marked = np.append(np.flatnonzero(marks[last] > marks[first]), -1)
    near = marked[np.searchsorted(marked[:-1], np.arange(len(first)))]  # the next line with a marker
    begin = np.flatnonzero(holds & (near >= 0) & (text[first] == text[first[near]]) & ((first[near] - first < most) | (near == np.arange(len(first))))) if len(first) else np.zeros(0, np.int64)
    runs, begin_at, length = [], begin, 0
    while len(begin_at):
        end = begin_at + length
        good = holds[end] & (marks[last[end]] > marks[first[begin_at]])
        runs.append((begin_at[good], end[good]))
        begin_at, end = begin_at[end + 1 < len(first)], end[end + 1 < len(first)]
        more = (text[first[end + 1]] == text[first[begin_at]]) & (first[end + 1] - first[begin_at] < most)
        begin_at, length = begin_at[more], length + 1
    begin, end = (np.concatenate([r[k] for r in runs] or [begin]) for k in (0, 1))
    order = np.lexsort([end, begin])
    first, last = first[begin[order]], last[end[order]]
    least = np.sqrt(_sums(scorer.idf[terms] ** 2, first, last))  # a norm is no less
    able = np.zeros(len(first), bool)
    for k in np.flatnonzero(bar <= 1):
        able |= _sums(scorer.part[terms, k], first, last) >= (bar[k] - 1e-6) * least
    return first[able], last[able]


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[last] - total[first]


def parent(path: Column) -> Column:
    """The directory of a path, "" for one at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned (path and the columns of scan) with licence, licence_score and licence_from: "notice", or the directory
    whose licence file counts; nulls if there is none.

    Of several licence files in a directory the one of the best score declares, then the first by name. Directories
    are joined, not documents: each directory's ancestors meet the declaring ones, and documents get their
    directory's answer. A null path inherits nothing.
    """
    mine = [c for c in scanned.columns if c not in ("licence", "licence_score", "licence_from")]
    scanned, back = graph.aside(scanned.select(*mine), ("path", "notice", "notice_score", "file_licence", "file_score"))
    scanned = scanned.withColumn("__dir", parent(F.col("path")))
    best = F.min(F.struct((-F.round("file_score", 9)).alias("less"), F.col("file_licence").alias("licence"), F.col("file_score").alias("score")))
    declared = scanned.filter("file_licence IS NOT NULL AND path IS NOT NULL").groupBy(F.col("__dir").alias("above")).agg(best.alias("best")).select("above", "best.licence", "best.score")
    dirs = scanned.filter("path IS NOT NULL").select("__dir").distinct()
    parts = F.split("__dir", "/")
    ancestors = F.when(F.col("__dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    )
    above = dirs.select("__dir", F.posexplode(ancestors).alias("depth", "above")).join(declared, "above")
    nearest = above.groupBy("__dir").agg(F.max(F.struct("depth", "above", "licence", "score")).alias("near")).select("__dir", "near.above", F.col("near.licence").alias("dl"), F.col("near.score").alias("ds"))
    out = scanned.join(nearest, "__dir", "left")
    own = F.col("notice").isNotNull()
    out = out.withColumns({"licence": F.coalesce("notice", "dl"), "licence_score": F.when(own, F.col("notice_score")).otherwise(F.col("ds")), "licence_from": F.when(own, F.lit("notice")).otherwise(F.col("above"))})
    return back(out.drop("__dir", "above", "dl", "ds"))
