"""Operator 3 against brute force with the frequencies of all words, and on real notices and licence files."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from test_models import SF, cosines, words_of

from clausewise.llm import license_scan

COMMON = ["in", "en", "the", "of", "and", "to", "a", "on"]


def idf_of(texts):
    df = Counter(w for t in texts for w in set(words_of(t)))
    return {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}


def test_frequencies_of_all_words_count(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400").collect()]
    rng = random.Random(3)
    rows += [(5000 + k, "\n".join(" ".join(rng.choices(COMMON, k=rng.randrange(9))) + " " + rng.choice(["released under the MIT License.", "Licensed under CC BY 4.0.", "x"]) for _ in range(2))) for k in range(60)]
    rows += [(6000, " ".join(COMMON) + " released under the MIT License."), (6001, "en on was licensed under the Apache License, Version 2.0."), (6002, None), (6003, ""), (6004, "ÜÇ " * 20_000)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    idf = idf_of([t for _, t in rows])
    alone = 0
    for k, text in rows:
        lines = [cosines(x, license_scan.TEMPLATES, idf, math.log(1 + len(rows)) + 1) for x in (text or "").split("\n")]
        best = max(max(c.values()) for c in lines)
        if best >= 0.7:
            assert got[k]["notice_score"] >= best - 1e-9
            alone += got[k]["notice_score"] == pytest.approx(best) and lines[got[k]["notice_line"]][got[k]["notice"]] == pytest.approx(best)
        whole = max(cosines(text, license_scan.TEMPLATES, idf, math.log(1 + len(rows)) + 1).values())
        if whole >= 0.5:
            assert got[k]["file_score"] >= whole - 1e-9
    assert alone > 40 and got[6000]["notice"] == "MIT" and got[6001]["notice"] == "Apache-2.0"


def runs_of(text, most):
    """(first line, text) of the runs of lines that scan() promises to score."""
    lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if words_of(x)]
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if j > i and sum(len(words_of(x)) for _, x in lines[i:j]) >= most:
                break
            yield lines[i][0], " ".join(x for _, x in lines[i : j + 1])


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
MIT = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 *
 * in the Software without restriction, including without limitation the rights
"""


def test_wrapped_notices_are_put_together(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 100").collect()]
    code = "import os\n\nfor name in os.listdir(path):\n    print(name, end='')\n"
    rows += [(5000, "#!/bin/sh\n#\n" + GPL + "\n" + code * 9), (5001, "/*\n" + MIT + " */\n" + code * 9), (5002, code + "# Released\n# under\n#\n# the MIT\n# License.\n" + code), (5003, code * 20), (5004, "Released under\n"), (5005, "the MIT License.")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[k]["notice"], got[k]["notice_line"]) for k in (5000, 5001, 5002, 5003)] == [("GPL-3.0", 2), ("MIT", 1), ("MIT", 4), (None, None)]
    assert got[5000]["notice_score"] > 0.999
    idf, most = idf_of([t for _, t in rows]), max(len(words_of(t)) for ts in license_scan.TEMPLATES.values() for t in ts)
    for k, text in rows[-30:]:
        scored = [(max(cosines(x, license_scan.TEMPLATES, idf, math.log(1 + len(rows)) + 1).items(), key=lambda c: round(c[1], 9)), line) for line, x in runs_of(text, most)]
        best = max((s[0][1] for s in scored), default=0)
        assert (got[k]["notice"] is not None) == (best >= 0.7 - 1e-9)
        if best >= 0.7:
            assert got[k]["notice_score"] == pytest.approx(best)
            assert got[k]["notice_line"] == min(line for (_, c), line in scored if c > best - 1e-9)


def test_licence_files_declare_their_directory(spark):
    place = "/usr/share/common-licenses"
    real = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = {want: open(f"{place}/{name}", encoding="utf-8").read() for name, want in real.items()}
    texts["MIT"] = license_scan.complete_texts()["MIT"][0].replace("<year> <copyright holders>", "2019-2024 Jane Q. Public and contributors").replace("software and", "software\nand")
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300").collect()]
    rows = [(f"prose/{k}.txt", t) for k, t in enumerate(prose)]
    rows += [(f"{name}/{kind}", text) for name, text in texts.items() for kind in ("LICENSE", "COPYING")]
    rows += [(f"{name}/src/deep/{k}.py", f"import os\nprint({k})\n") for name in texts for k in range(3)]
    rows += [("GPL-3.0/vendor/LICENSE", texts["MIT"]), ("GPL-3.0/vendor/a.py", "pass"), ("MIT/b.py", GPL + "\n".join(f"total_{k} = load_{k}(path) + offset" for k in range(60))), ("c.py", "pass")]
    scanned = license_scan.scan(spark.createDataFrame(rows, "path string, text string"))
    got = {r["path"]: r for r in license_scan.inherit(scanned).collect()}
    for name in texts:
        assert got[f"{name}/LICENSE"]["file_licence"] == name and got[f"{name}/LICENSE"]["file_score"] > 0.9
        assert {(got[f"{name}/src/deep/{k}.py"]["licence"], got[f"{name}/src/deep/{k}.py"]["licence_from"]) for k in range(3)} == {(name, name)}
    assert got["GPL-3.0/vendor/a.py"]["licence"] == "MIT" and got["MIT/b.py"]["licence_from"] == "notice" and got["c.py"]["licence"] is None
    notices = set(license_scan.TEMPLATES)
    assert len(got) == len(rows) and all(r["file_score"] is None or r["file_licence"] in notices for p, r in got.items() if p.startswith("prose/"))


def test_segments_are_scored_in_chunks(monkeypatch):
    scorer = license_scan.Scorer(license_scan.TEMPLATES, {})
    scorer.weigh(9, np.arange(len(scorer.terms)) % 9)
    rng = np.random.default_rng(1)
    words = rng.choice(np.append(scorer.terms, np.arange(1, 40, dtype=np.uint64)), 3000)
    start = np.sort(rng.integers(0, 2900, 400))
    segment, word, count = license_scan.condense(words, start, start + rng.integers(1, 90, 400))
    terms = scorer.term_of(word)
    at_once = scorer.cosines(segment, terms, count, scorer.idf[terms], 400)
    monkeypatch.setattr(license_scan, "SCORED_WORDS", 50)
    assert len(list(license_scan._chunks(np.bincount(segment)))) > 50
    assert np.allclose(scorer.cosines(segment, terms, count, scorer.idf[terms], 400), at_once) and at_once.max() > 0.5
