"""Operators 3, 7, 8 and 10 and the pipeline: held-out accuracy, brute force, edge cases."""

import importlib.util
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewise.llm import bytesops, decontaminate, lang_id, license_scan, line_dedup, piece_sampling, queries, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def near(name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(os.path.dirname(__file__), f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_op7_is_right_on_held_out_texts(spark):
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {d["doc_id"] for d in docs}
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) for d in docs)
    assert len(held) > 200 and sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)


def test_op7_edge_cases(spark):
    rows = [(k, "the cat and the dog " * 5, "en", "x") for k in range(30)] + [(100 + k, "der Hund und die Katze " * 5, "de", "y") for k in range(30)]
    rows += [(200, None, "en", ""), (201, "", "de", ""), (202, "123 ... !!", "de", ""), (203, "der Hund " * 30_000, None, ""), (None, "the cat", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = lang_id.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], 0 <= r["score"] <= 1) for r in lang_id.identify(docs, model).collect()}
    assert got[0] == ("en", True) and got[100] == ("de", True) and got[203] == ("de", True) and got[None] == ("en", True)
    assert {got[k][0] for k in (200, 201, 202)} == {"und"}
    assert lang_id.fit(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in lang_id.identify(docs, None).collect()} == {"und"}
    assert lang_id.identify(docs.limit(0), model).collect() == []
    assert {r["doc_id"] for r in lang_id.identify(docs, model, reject_below=0.5).collect()} == {r[0] for r in rows} - {200, 201, 202}


def convolved(text, model):
    """Probabilities by direct convolution, byte for byte, in double precision."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    total = np.zeros(len(model.languages))
    for at in range(0, len(data), lang_id.WINDOW):
        part, hidden = data[at : at + lang_id.WINDOW], []
        for width, filters, bias in zip(lang_id.WIDTHS, model.filters, model.bias, strict=True):
            seen = [part[i : i + width] for i in range(len(part) - width + 1) if 0 not in part[i : i + width]]
            answers = [sum(model.embedding[b].astype(float) @ filters[j].astype(float) for j, b in enumerate(x)) + bias for x in set(seen)]
            hidden += np.maximum(np.max(answers, axis=0), 0).tolist() if answers else [0.0] * lang_id.FILTERS
        raw = np.array(hidden) @ model.dense + model.dense_bias
        total += np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum() * len(part)
    return total / len(data)


def test_op7_equals_direct_convolution(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, "a"), (-2, "AB"), (-3, "x\x00y\x00zz"), (-4, "ä" * 200), (-5, "\x00" * 300 + "q")], "doc_id long, text string")
    model = lang_id.fit(docs, F.lit(True))
    asked = docs.select("doc_id", "text").filter("length(text) < 3000").unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in asked.collect()}
    n = 0
    for r in lang_id.identify(asked, model).collect():
        text = texts[r["doc_id"]]
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        want = convolved(text, model)
        assert abs(r["score"] - want.max()) < 1e-4 and want[model.languages.index(r["lang_pred"])] > want.max() - 1e-4
        n += 1
    assert n > 100


def named(text):
    """The features of a text by name: words, neighbours, and pairs around a word."""
    w = words_of(text)
    return {(a,) for a in w} | {(a, b, 1) for a, b in zip(w, w[1:], strict=False)} | {(a, b, 2) for a, b in zip(w, w[2:], strict=False)}


def slot(feature):
    """The place of a feature, by whole numbers of Python."""

    def word(x):
        data = np.frombuffer(x.encode(), np.uint8)
        return int(bytesops.word_hashes(data, np.array([0, len(data)]))[0][0])

    if len(feature) == 1:
        return word(feature[0]) >> (64 - toxicity.BITS)
    h = (word(feature[0]) * {1: 0xC2B2AE3D27D4EB4F, 2: 0x165667B19E3779F9}[feature[2]] + word(feature[1])) % 2**64
    for k in range(2):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return (h ^ (h >> 32)) >> (64 - toxicity.BITS)


def test_op8_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SETTINGS", ((2.0, 0.15),))
    made = [" ".join(f"w{(k * k + i * (k % 7 + 1)) % 40}" for i in range(k % 23 + 1)) + (" vile" if k % 3 == 0 else " Kind É") for k in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    alpha, beta, l1, l2, z, n = 0.15, 1.0, 2.0, 1.0, {}, {}

    def weight(i):
        if i == "bias":
            return -z.get(i, 0.0) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n[i])) / alpha + l2)

    slots = [{slot(f) for f in named(t)} for t in made]
    rng = np.random.default_rng(3)
    for _ in range(4):
        for k in rng.permutation(120):
            w = {i: weight(i) for i in [*slots[k], "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - (k % 3 == 0)
            for i, wi in w.items():
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * wi
    model = toxicity.fit(docs, labels, F.lit(True))
    learnt = {i: weight(i) for i in n if i != "bias" and weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(learnt, abs=1e-9) and learnt
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k in range(120):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-model.bias - sum(learnt.get(i, 0) for i in slots[k]))), abs=1e-6)
    assert model.bias - weight("bias") in (pytest.approx(x / 4, abs=1e-9) for x in range(13))


def test_op8_chooses_settings_that_find_most_held_out_toxic_texts(spark):
    """Against the labels of sf0.1: most toxic held-out texts are found at 0.5, and few others are called toxic."""
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL")
    held = queries.op8_toxicity(spark, sf).filter("held_out").join(known, "doc_id").select("predicted", "toxic").collect()
    found, all_ = sum(r["predicted"] and r["toxic"] for r in held), sum(r["toxic"] for r in held)
    assert found > 0.7 * all_ and sum(r["predicted"] and not r["toxic"] for r in held) < 0.02 * len(held)


def test_op8_learns_from_texts_of_any_length_and_the_same_ones_each_time(spark):
    long = " ".join(f"word{k}" for k in range(6000))
    docs = spark.createDataFrame([(1, long + " vile"), (2, long), (2, "kind words"), (3, "vile thing"), (4, "a kind thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 7), (None, 1)], "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(n), labels, F.lit(True)) for n in (1, 3)]
    assert models[0].bias == models[1].bias != 0 and (models[0].index == models[1].index).all()
    assert toxicity.fit(docs.filter("doc_id = 1"), labels, F.lit(True)).bias > 0


def test_op8_ranks_held_out_texts(spark):
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in labels)
    bad = [got[r["doc_id"]]["score"] for r in labels if r["toxic"] == 1]
    fine = [got[r["doc_id"]]["score"] for r in labels if r["toxic"] == 0]
    better = sum((a > b) + (a == b) / 2 for a in bad for b in fine) / (len(bad) * len(fine))
    assert better > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_op8_edge_cases(spark):
    rows = [(k, "you are an idiot " + "filler words " * (k % 7) if k % 3 == 0 else "a kind and gentle text " + "filler words " * (k % 5), 1) for k in range(300)]
    rows += [(900, None, 0), (901, "", 0), (902, "word " * 50_000, 0), (None, "idiot", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(5, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[k] == int(k % 3 == 0) for k in range(300)) and got[None] == 1
    assert got[900] == got[901] == int(toxicity.sigmoid(model.bias) >= 0.5)
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def brute_windows(docs, items, n=10):
    found = {}
    for k, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for k, text in docs:
        w, hit, names = words_of(text), set(), set()
        for size in {len(x) for x in found}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in found:
                    hit |= set(range(i, i + size))
                    names |= found[tuple(w[i : i + size])]
        out.append((k, len(w), len(hit), len(names), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [128 << 20, 0])
def test_op10_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    long = " ".join(f"w{k}" for k in range(40))
    items = [(1, long), (2, "Short Item É"), (3, None), (4, "..."), (5, " ".join(f"w{k}" for k in range(5, 25))), (5, "one")]
    docs = [(1, long.upper()), (2, "x short, item É y"), (3, "short item é"), (4, None), (5, ""), (6, long + " z " + long), (7, "a w1 w2 w3 w4"), (7, "one"), (8, "one"), (8, "one"), (None, "one")]
    docs += [(9, " ".join(f"w{k}" for k in range(9)))]
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, pos int"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontamination_report(d, b).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()), key=str)
    assert got == brute_windows(docs, items)
    clean = {(r["doc_id"], r["text"]) for r in decontaminate.decontaminate(d, b).collect()}
    assert clean == {(3, "short item é"), (4, None), (5, ""), (7, "a w1 w2 w3 w4"), (9, docs[-1][1])}
    spans = {(r["doc_id"], r["text"]) for r in decontaminate.decontaminate(d, b, remove="spans").collect()}
    assert clean <= spans and (6, "z") in spans and (2, "x y") in spans
    assert decontaminate.decontamination_report(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontamination_report(d.limit(0), b).collect() == []


def test_op10_broadcast_counts_bytes(spark, monkeypatch):
    # few windows, but one that many items share: its items alone exceed the bound
    docs = spark.createDataFrame([(1, "the same item")], "doc_id long, text string")
    items = spark.createDataFrame([(f"item-{k:04d}", "the same item") for k in range(300)], "item_id string, text string")
    sent = {}
    for bound in (300 * 9, 1 << 20):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        found = decontaminate.hits(docs, items)
        sent[bound] = "ResolvedHint" in found._jdf.queryExecution().analyzed().toString()
        assert [(r["n_words"], len(r["items"])) for r in found.collect()] == [(3, 300)]
    assert list(sent.values()) == [False, True]


def cosines(text, templates, idf, default):
    a = Counter(words_of(text))
    out = {}
    for name, texts in templates.items():
        for t in texts:
            b = Counter(words_of(t))
            w = lambda c, x: c[x] * idf.get(x, default)
            size = math.sqrt(sum(w(a, x) ** 2 for x in a) * sum(w(b, x) ** 2 for x in b))
            out[name] = max(out.get(name, 0), sum(w(a, x) * w(b, x) for x in a) / size if size else 0)
    return out


def test_op3_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150 OR text ILIKE '%licen%'").collect()]
    rows += [(5000, license_scan.TEMPLATES["BSD-3-Clause"][1]), (5001, "Released under the MIT license!\nRELEASED under the mit LICENSE"), (5002, None), (5003, ""), (5004, "licensed under"), (5005, "a\n\nLicensed under CC BY 4.0.\n" + "text " * 40_000)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, notice string")).collect()}
    terms = {w for ts in license_scan.TEMPLATES.values() for t in ts for w in words_of(t)}
    df = Counter(w for _, t in rows for w in set(words_of(t)) & terms)
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in terms}
    for k, text in rows:
        lines = [cosines(x, license_scan.TEMPLATES, idf, math.log(1 + len(rows)) + 1) for x in (text or "").split("\n")]
        best = max((max(c.values()) for c in lines), default=0)
        assert (got[k]["notice"] is not None) == (best >= 0.7 - 1e-9)
        if best >= 0.7:
            assert got[k]["notice_score"] == pytest.approx(best) and lines[got[k]["notice_line"]][got[k]["notice"]] == pytest.approx(best)
        whole = max(cosines(text, license_scan.TEMPLATES, idf, math.log(1 + len(rows)) + 1).values())
        assert (got[k]["file_licence"] is not None) == (whole >= 0.5 - 1e-9)
    assert got[5001]["notice_line"] == 0 and got[5005]["notice"] == "CC-BY-4.0"


def test_op3_inherits_from_the_nearest_directory(spark):
    columns = "path string, notice string, notice_score double, file_licence string, file_score double"
    rows = [("LICENSE", None, None, "MIT", 0.9), ("a/b/LICENSE", None, None, "GPL-3.0", 0.8), ("a/b/COPYING", None, None, "Apache-2.0", 0.8), ("a/x.py", None, None, None, None)]
    rows += [("a/b/c/d.py", None, None, None, None), ("a/b/c/e.py", "ISC", 0.95, None, None), ("ab/f.py", None, None, None, None), (None, None, None, None, None)]
    got = {r["path"]: (r["licence"], r["licence_from"]) for r in license_scan.inherit(spark.createDataFrame(rows, columns)).collect()}
    assert got["a/x.py"] == ("MIT", "") and got["ab/f.py"] == ("MIT", "") and got["a/b/c/d.py"] == ("Apache-2.0", "a/b") and got["a/b/c/e.py"] == ("ISC", "notice") and got[None] == (None, None)
    assert license_scan.inherit(spark.createDataFrame([], columns)).collect() == []
    assert queries.op3_license_scan(spark, SF).filter("licence_from = 'notice'").count() > 10


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on its own input, as run() chains them."""
    source = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 220")
    extra = [(1000, None, "en", "s", 0), (1001, "12 34 ..", "en", "s", 8), (1002, "", "en", "s", 0)]
    sf = str(tmp_path)
    source.unionByName(spark.createDataFrame(extra, source.schema)).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect()) if name != "language_id" else []
        out = spark.read.parquet(f"{sf}/{name}")
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert set(rows) == {r["doc_id"] for r in docs.collect()} - {1000, 1001, 1002}
        elif name == "line_dedup":
            want = near("test_lines").brute(before, line_dedup.NEAR_CHARS)
            assert rows == {w[0]: w[4] for w in want if w[2] < w[1]}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "ngram_jaccard":
            other = near("test_near")
            want = other.roots([k for k, _ in before], other.jaccard_links(other.gram_sets(before)))
            assert set(rows) == {k for k, root in want.items() if k == root}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(rows) == {b[0] for b in brute_windows(before, items) if not b[4]}
        else:
            assert sorted(rows.items()) == before
            v = piece_sampling.Vocabulary(queries.vocabulary("piece_bpe_32k.model"), 1.0)
            assert all(b"".join(v.bytes[i] for i in r["pieces"])[1:].decode() == r["text"] for r in out.collect())
        if name != "sentencepiece":
            assert out.columns == docs.columns
        kept.append(len(rows))
        docs = out
    assert kept == sorted(kept, reverse=True) and kept[-1] > 50
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(rows)
