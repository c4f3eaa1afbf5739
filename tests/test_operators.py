"""Operators on small literal frames: edges of rules, quirks and empty inputs."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from clausewise.functions import encode, text, vector
from clausewise.operators import audit, chunking, layout, match, reports, store, tfidf, titles
from clausewise.sources import files, index, schema
from clausewise.streaming import ingest

AS_OF = datetime.date(2025, 1, 1)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


def rules(spark, contract):
    audited = audit.audit(spark.createDataFrame([(1, contract)], "doc_id long, text string"), AS_OF)
    row = audited.first()
    return row["status"], {v["rule_id"]: (v["description"], v["found_text"]) for v in row["violations"]}


PAD = "Стороны согласовали предмет, цена и стоимость указаны ниже в тексте. "


@pytest.mark.parametrize("contract", [None, "", " \n\t ", "x" * 49])
def test_audit_cannot_judge(spark, contract):
    assert rules(spark, contract) == (audit.UNKNOWN, {})


def test_audit_standard_contract(spark):
    sound = PAD + "Срок действия договора 2 года.\nОплата в течение 60 календарных дней.\nПлатежный день: один раз в неделю."
    assert rules(spark, sound) == (audit.STANDARD, {})
    assert rules(spark, "x" * 50)[0] == audit.NONSTANDARD


@pytest.mark.parametrize(
    "clause,rule,found",
    [
        ("Срок действия договора 4 года", "L2c", "Срок действия договора 4 года"),
        ("Срок действия договора 36 месяцев", None, None),
        ("Срок действия договора 37 месяцев", "L2c", "Срок действия договора 37 месяцев"),
        ("Срок действия договора до 31 февраля 2026 года", "L2e", "Срок действия договора до 31 февраля 2026 года"),
        ("Срок действия договора до 1 мая 2028 года", "L2d", "Срок действия договора до 1 мая 2028 года"),
        ("Срок действия договора до 1 декабря 2027 года", None, None),
        ("Срок действия договора до 31.12.2028", "L2e", "Срок действия договора до 31"),
        ("Договор действует бессрочно", "L2b", "Договор действует бессрочно"),
        ("Нет такого условия", "L2f", ""),
    ],
)
def test_audit_term(spark, clause, rule, found):
    got = {k: v for k, v in rules(spark, f"{PAD}{clause}. И далее.")[1].items() if k.startswith("L2")}
    assert {k: v[1] for k, v in got.items()} == ({rule: found} if rule else {})


@pytest.mark.parametrize(
    "clause,rule,label",
    [
        ("в течение 42 рабочих дней", "L3a", "42 рабочих дн."),
        ("в течение 43 рабочих дней", None, None),
        ("в течение 59 календарных дней", "L3a", "59 дн."),
        ("в течение 60 календарных дней", None, None),
        ("в течение 10 календарных дней по закона", None, None),
        ("Оплата в течение сорока пяти дней", "L3b", "45 дней"),
        ("Оплата в течение сорока дней", "L3b", "40 дней"),
        ("Оплата в течение шестидесяти дней", None, None),
        ("Оплата когда-нибудь", "L3c", "не найдено"),
    ],
)
def test_audit_payment(spark, clause, rule, label):
    got = {k: v for k, v in rules(spark, f"{PAD}\n{clause}\nконец")[1].items() if k.startswith("L3")}
    assert list(got) == ([rule] if rule else [])
    assert rule is None or label in got[rule][0]


def test_audit_quirks(spark):
    assert "L10" in rules(spark, "Отзыв заявки принимается в любое время суток без ограничений по времени")[1]
    assert "L5" not in rules(spark, PAD + "Оказание услуг. Приемка, контракт, 7 рабочих дней")[1]
    assert rules(spark, PAD + "Услуги: акт в течение 3 рабочих дней")[1]["L5"][1] == "акт в течение 3 рабочих дн"
    assert rules(spark, PAD + "Особые условия: поставка. Далее")[1]["L8"][1] == "Особые условия: поставка"
    assert "L8" not in rules(spark, PAD + "Особые условия: гарантийный срок. Далее")[1]
    assert rules(spark, PAD + "По форме контрагента")[1]["L1"][1] == "По форме контрагента"
    assert "L4" not in rules(spark, PAD + "Без предоплаты. Аванс не предусмотрен.")[1]
    assert rules(spark, PAD + "Без предоплаты. Аванс 30%.")[1]["L4"][1] == "Аванс 30%"


def test_violation_categories(spark):
    names = {audit.D_NO_TERM: "Срок действия", audit.D_PAYMENT: "Условия оплаты", audit.D_NO_PAYMENT: "Прочие", audit.D_PAY_DAY: "Прочие", audit.D_PROTOCOL: "Прочие", audit.D_PREPAID: "Предоплата", audit.D_NO_ACCEPT: "Приемка работ"}
    df = spark.createDataFrame([(d,) for d in names], "d string").select("d", audit.category(F.col("d")).alias("c"))
    assert {r["d"]: r["c"] for r in df.collect()} == names


def test_bands_part_all_scores(spark):
    scores = {None: "unknown", 0.0: "unknown", 0.9: "match", 1.0: "match", 1.0000001: "no_match", 0.8: "likely", 0.8999: "likely", 0.7999: "no_match", -0.1: "no_match"}
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", match.band(F.col("s")).alias("b"))
    assert {r["s"]: r["b"] for r in df.collect()} == scores


VECTORS = "id string, embedding array<double>, title_emb array<double>"


def test_match_ties_blend_and_missing_vectors(spark):
    t = spark.createDataFrame([("b", [1.0, 0.0], [0.0, 1.0]), ("a", [1.0, 0.0], None), ("c", [0.0, 0.0], [1.0, 0.0]), ("d", None, None)], VECTORS)
    d = spark.createDataFrame([("x", [2.0, 0.0], None), ("y", [1.0, 0.0], [0.0, 3.0]), ("z", [0.0, 0.0], None), ("n", None, [1.0, 0.0]), ("o", [-1.0, 0.0], None)], VECTORS)
    got = {r["id"]: (r["template_id"], round(r["score"], 6), r["title_score"]) for r in match.match(d, t).collect()}
    assert got == {"x": ("a", 1.0, 0.0), "y": ("b", 1.0, 1.0)}
    two = [(r["id"], r["template_id"], r["rank"]) for r in match.match(d, t, k=2, block_bytes=1).collect()]
    assert sorted(two) == [("x", "a", 1), ("x", "b", 2), ("y", "a", 2), ("y", "b", 1)]
    assert match.match(d, t.limit(0)).collect() == [] and match.match(d.limit(0), t).collect() == []
    assert match.counters(spark.createDataFrame([], "score double")).first()["rate"] == 0.0


def test_match_ranks_in_the_task_as_over_blocks(spark):
    t = spark.createDataFrame([(f"t{k}", [float(k % 3), 1.0, float(k % 5)], [1.0, float(k % 4), 0.0]) for k in range(12)], VECTORS)
    d = spark.createDataFrame([(f"d{k}", [1.0, float(k), 2.0], [float(k), 1.0, 1.0] if k % 2 else None) for k in range(9)], VECTORS)
    d = d.unionByName(spark.createDataFrame([("null in it", [1.0, None, 1.0], None), ("nan", [1.0, float("nan"), 1.0], None), ("narrow", [1.0], None)], VECTORS))
    shown = lambda df: sorted((r["id"], r["rank"], r["template_id"], round(r["score"], 9)) for r in df.collect())
    whole = match.match(d, t, k=4)
    assert shown(whole) == shown(match.match(d, t, k=4, block_bytes=200)) and {r[0] for r in shown(whole)} == {f"d{k}" for k in range(9)}
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_offsets_are_ranks_and_running_totals(spark):
    rows = [(k * 7 % 50, i) for k in range(50) for i in range(k % 4 + 1)]
    for kind in ("long", "string"):
        chunks = spark.createDataFrame(rows, "doc_id long, ord int").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = {(r["doc_id"], r["ord"]): (r["template_id"], r["vec_offset"]) for r in chunking.offsets(chunks).collect()}
        keys = sorted({k for k, _ in got})
        assert got == {k: (keys.index(k[0]) + 1, at) for at, k in enumerate(sorted(got))}
    assert chunking.offsets(chunks.limit(0)).collect() == []


def test_stored_texts_are_audited_with_their_chunks(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    chunks = spark.createDataFrame([(1, 1, "Предоплата не предусмотрена."), (1, 0, PAD)], "doc_id long, ord int, text string")
    got = {r["doc_id"]: r for r in audit.audit_stored(docs, chunks, AS_OF).collect()}
    assert got[1]["error"] is None and got[1]["status"] == audit.NONSTANDARD
    assert got[2]["error"] == audit.E_NO_TEXT and got[2]["status"] == audit.UNKNOWN and got[2]["violations"] == []


def test_lists_lookups_and_migration(spark):
    t = spark.createDataFrame([("1", "Жук", 1), ("2", "Ёж", 2), ("3", "Аист", 3), ("4", "Аист", 4)], "id string, name string, extra int")
    assert [r["id"] for r in reports.by_name(t).collect()] == ["2", "3", "4", "1"]
    assert [r["id"] for r in reports.by_name(t, "UNICODE").collect()] == ["3", "4", "2", "1"]
    assert [r["id"] for r in reports.browse(t, 2).collect()] == ["1", "2"]
    assert reports.lookup(t, "3").count() == 1 and reports.lookup(t, "x").count() == 0 and reports.lookup(t, None).count() == 0
    assert [r["id"] for r in reports.referred(t, spark.createDataFrame([("2",), ("2",), (None,), ("9",)], "similar_id string")).collect()] == ["2"]
    new = store.migrate(t, "id string, title string, name string")
    assert new.columns == ["id", "title", "name", "extra"] and {r["title"] for r in new.collect()} == {None}


def test_vector_expressions(spark):
    assert one(spark, [3.0, 4.0], lambda v: vector.norm(v), "array<double>") == 5.0
    assert one(spark, [0.0, 0.0], lambda v: vector.cosine(v, v), "array<double>") is None
    assert one(spark, [1.0], lambda v: vector.resize(v, 3), "array<double>") == [1.0, 0.0, 0.0]
    assert one(spark, [1.0, 2.0, 3.0], lambda v: vector.resize(v, 2), "array<double>") == [1.0, 2.0]
    assert one(spark, [0.1234567], lambda v: vector.quantise(v), "array<double>")[0] == pytest.approx(0.123457)
    got = encode.with_encoder(spark.createDataFrame([("a b a",), ("",), (None,)], "t string"), "t", "e").collect()
    assert sum(x * x for x in got[0]["e"]) == pytest.approx(1) and not any(got[1]["e"]) and not any(got[2]["e"])


def test_text_expressions(spark):
    assert one(spark, "  \ta b\n ", text.strip) == "a b"
    assert one(spark, "a\r\nb c\n", text.lines) == ["a", "b", "c"]
    assert one(spark, "a\n\n", text.lines) == ["a", ""]
    assert one(spark, "a.b.c", lambda t: text.index_of(t, ".", 2)) == 3
    assert one(spark, "abc", lambda t: text.index_of(t, ".")) == -1
    assert one(spark, "a.b.c", lambda t: text.last_index_before(t, ".", F.lit(3))) == 1


def chunk_by_hand(blocks):
    """The chunker's state machine in plain Python."""
    buff, path, out = "", [], []

    def flush():
        nonlocal buff
        t = buff.strip()
        out.append((t, " > ".join(path)))
        buff = t[-200:] + "\n"

    for kind, level, t in blocks:
        if kind == "heading":
            if len(buff) >= 600:
                flush()
            path = (path[: level - 1] if level <= len(path) else path) + [t]
            piece = f"\n# {t}\n"
        else:
            piece = t + "\n"
        if buff and len(buff) + len(piece) > 2000:
            flush()
        buff += piece
        if len(buff) >= 1200:
            flush()
    if buff:
        flush()
    return out


def test_chunks_equal_the_state_machine(spark):
    word = "слово "
    cases = [
        [("paragraph", None, word * 90), ("heading", 1, "ГЛАВА 1"), ("heading", 2, "А"), ("paragraph", None, word * 150), ("heading", 1, "ГЛАВА 2"), ("paragraph", None, word * 700)],
        [("paragraph", None, "x " * 460), ("paragraph", None, "y" * 2500), ("heading", 1, "T"), ("paragraph", None, "z " * 500)],
        [("paragraph", None, ("w " * 599).strip()), ("paragraph", None, "v" * 1), ("heading", 1, "H"), ("paragraph", None, "u " * 400)],
    ]
    rows = [(k, [(a, b, c.strip()) for a, b, c in case]) for k, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, b array<{chunking.BLOCK}>")
    for r in df.select("k", chunking.chunk(F.col("b")).alias("c")).collect():
        assert [(c["text"], c["heading"]) for c in r["c"]] == chunk_by_hand(rows[r["k"]][1])
    few = spark.createDataFrame([([("paragraph", None, "a"), ("heading", 1, "B")],), ([],)], f"b array<{chunking.BLOCK}>").select(chunking.chunk(F.col("b")).alias("c")).collect()
    assert [c["text"] for c in few[0]["c"]] == ["a\n\nB"] and [c["text"] for c in few[1]["c"]] == [""]


def test_blocks_and_boilerplate(spark):
    kinds = {"ГЛАВА 1 общая": "heading", "1. Предмет": "heading", "ABC": "heading", "обычный текст": "paragraph", "123": "paragraph", "A" * 100: "paragraph"}
    for t, kind in kinds.items():
        assert one(spark, t, chunking.block)["type"] == kind
    assert one(spark, "x", lambda t: chunking.block(t, F.lit("{'Heading': 9}")))["level"] == 6
    footer = [("paragraph", None, "стр. из")] * 6
    got = one(spark, [*footer, ("paragraph", None, "a  b\t c"), ("paragraph", None, "--")], chunking.clean, f"array<{chunking.BLOCK}>")
    assert [b["text"] for b in got] == ["a b c"]
    assert len(one(spark, footer[:5], chunking.clean, f"array<{chunking.BLOCK}>")) == 5
    long = [("paragraph", None, "y" * 81)] * 6
    assert len(one(spark, long, chunking.clean, f"array<{chunking.BLOCK}>")) == 6
    assert one(spark, [("paragraph", None, "слово " * 901)], chunking.pages, f"array<{chunking.BLOCK}>") == 4


def test_titles(spark):
    paragraphs = "array<string>"
    assert one(spark, ["", "Д о г о в о р № 5/1 от вчера", "поставки товара"], titles.from_heading, paragraphs) == "ДОГОВОР поставки товара"
    assert one(spark, ["Договор аренды", "г. Москва"], titles.from_heading, paragraphs) == "Договор аренды"
    assert one(spark, ["Акт"], titles.from_heading, paragraphs) is None
    assert one(spark, ["Contract # 5", "Договор № 7"], titles.from_cells, paragraphs) == "Contract Договор"
    assert one(spark, ["", "Акт сверки от 01.02.2024 года"], titles.from_first_paragraph, paragraphs) == "Акт сверки"
    assert one(spark, ["№ 5", "Акт от Ивана"], titles.from_first_paragraph, paragraphs) == "Акт"
    assert one(spark, ["x", "Contract Договор № 5"], titles.from_page_lines, paragraphs) == "Contract Договор Contract Договор"
    assert one(spark, [], titles.from_page_lines, paragraphs) == ""
    # blanks around a line and words at its end decide nothing; nulls are passed over
    assert one(spark, [" Акт к договору", None, "\tДоговор\u00a0№ 7 ", "  "], titles.from_heading, paragraphs) == "Договор"
    assert one(spark, ["договор", " от 5 мая"], titles.from_heading, paragraphs) == "договор"
    assert one(spark, [" \u00a0", "ОТ Ивана", None, " № 5 от 01.02.2024", "Акт ОТ x"], titles.from_first_paragraph, paragraphs) == "№ 5"
    assert one(spark, [None, "  the  CONTRACT  № 4 "], titles.from_page_lines, paragraphs) == "the CONTRACT"


def test_reports_and_store(spark):
    docs = spark.createDataFrame([("d1", "n", None, "t1", 0.0, "s1", None), ("d2", "n", None, "t9", 0.5, None, "t1")], "id string, name string, created_at timestamp, similar_id string, similarity_score double, session_id string, user_choice_doc_id string").withColumn("version", F.lit(None).cast("string"))
    lib = spark.createDataFrame([("t1", "L", "1"), ("t2", "L", "1")], "id string, name string, version string")
    got = [tuple(r) for r in reports.results(docs, lib).select("id", "template_name", "score").collect()]
    assert got == [("d1", "L", None), ("d2", None, 0.5)]
    assert [tuple(r) for r in reports.options(lib).collect()] == [("L (v1)", "t2")]
    chunks = spark.createDataFrame([("d1:0", "d1", 0, "", "a"), ("d2:0", "d2", 0, "", "b")], "chunk_id string, doc_id string, ord int, heading string, text string")
    left, kept = store.clear_session(docs, chunks, "s1")
    assert [r["id"] for r in left.collect()] == ["d2"] and [r["doc_id"] for r in kept.collect()] == ["d2"]
    assert store.insert_new(chunks, chunks.unionByName(chunks), "chunk_id").count() == 2
    assert store.update_choice(docs, "none", "t2").filter("user_choice_doc_id = 't2'").count() == 0
    assert [r["id"] for r in store.orphans(docs, "similar_id", lib).collect()] == ["d2"]
    empty = spark.createDataFrame([], schema.TEMPLATES)
    assert store.insert(empty, lib, {"is_active": True}).filter("is_active").count() == 2


def test_reading_order(spark):
    two = [(1, float(300 * (k % 2)), float(k), float(300 * (k % 2) + 100), float(k) + 1, f"b{k}") for k in range(8)]
    few = [(2, 0.0, 5.0, 1.0, 6.0, "low"), (2, 300.0, 1.0, 301.0, 2.0, "high"), (2, 0.0, 0.0, 1.0, 1.0, "  ")]
    df = spark.createDataFrame(two + few, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = layout.reading_order(df, ["page"]).orderBy("page", "pos").collect()
    assert [r["text"] for r in got] == ["b0", "b2", "b4", "b6", "b1", "b3", "b5", "b7", "high", "low"]


def test_totals_of_similarities_are_those_of_the_pairs(spark, monkeypatch):
    texts = [" ".join(f"w{(k * j) % 31}" for j in range(2, 4 + k % 6)) for k in range(90)] + ["alone here", "", "w1 w1 w2", "w1 w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(5)
    pairs = tfidf.similarity(tfidf.weights(docs, key="id"), docs.filter("id % 2 = 0").select("id"), "id")
    want = {r["query"]: (r["n"], round(r["t"], 9), round(r["b"], 9)) for r in pairs.groupBy("query").agg(F.count("*").alias("n"), F.sum("similarity").alias("t"), F.max("similarity").alias("b")).collect()}
    model = tfidf.fit(docs, key="id")
    made = tfidf.sparse(docs, "text", "embedding", model)
    for held, tile in ((match.HELD_BYTES, match.TILE_BYTES), (2000, 1000)):
        monkeypatch.setattr(match, "HELD_BYTES", held)
        monkeypatch.setattr(match, "TILE_BYTES", tile)
        found = tfidf.totals(made, made.filter("id % 2 = 0"), len(model.terms), 8000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan  # no row for a pair
        assert {r["query"]: (r["n"], round(r["total"], 9), round(r["best"], 9)) for r in found.collect()} == want and 90 not in want


def test_equal_blocks_are_read_in_order_of_their_numbers(spark):
    rows = [(1, k, 0.0, 0.0, 9.0, 9.0, "same") for k in (5, 2, 9, 0, 7, 1)] + [(1, 8, 0.0, 0.0, 9.0, 9.0, "first")]
    df = spark.createDataFrame(rows, "page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    for parts in (1, 3):
        got = layout.reading_order(df.repartition(parts), ["page"], ["ord"]).orderBy("pos").collect()
        assert [r["ord"] for r in got] == [8, 0, 1, 2, 5, 7, 9]


def test_tfidf_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha beta beta"), (3, "gamma"), (4, None), (5, "x")], "doc_id long, text string")
    w = tfidf.weights(df)
    assert w.select("doc_id").distinct().count() == 3
    got = tfidf.similarity(w, df.filter("doc_id = 1").select("doc_id")).collect()
    assert [(r["query"], r["doc_id"], round(r["similarity"], 6)) for r in got] == [(1, 2, 1.0)]


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:pPr><w:pStyle w:val='{}'/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>"
TABLE = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\n\n\n two \n\n", "utf-8")
    (tmp_path / "in" / "deep" / "b.txt").write_bytes("договор".encode("cp1251"))
    (tmp_path / "in" / "c.docx").write_bytes(docx(P.format("Heading2", "Title") + TABLE + P.format("x", "last")))
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "E.TXT").write_text("other suffix")
    (tmp_path / "in" / "empty.txt").write_text("")
    got = files.read_elements(spark, str(tmp_path / "in")).orderBy("doc_path", "order").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["category"], r["element_type"], r["text"], r["order"]))
    assert by["a"] == [("in", "paragraph", "one", 0), ("in", "paragraph", "two", 1)]
    assert by["b"] == [("deep", "paragraph", "договор", 0)]
    assert [x[2] for x in by["c"]] == ["Title", "last", "a\tb", ""]
    assert {r["doc_id"] for r in got if r["parse_error"]} == {"bad", "d"} and "E" not in by and "empty" not in by
    headed = files.read_elements(spark, str(tmp_path / "in"), ("docx",), {"docx": files.parse_docx_headings}).filter("doc_id = 'c'").orderBy("order").collect()
    assert [(r["element_type"], r["text"]) for r in headed] == [("heading", "Title"), ("table", "a | b\n"), ("paragraph", "last")]
    assert headed[0]["metadata"] == {"heading": "2"}


def test_a_reader_of_pages_that_is_passed_in_feeds_the_reading_order(spark, tmp_path):
    def pages(content):
        left, right = content.decode().split("|")
        spots = [(0.0, y, t) for y, t in enumerate(left)] + [(300.0, y, t) for y, t in enumerate(right)]
        return [{"element_type": "paragraph", "text": t, "page": 1, "bbox": [x, float(y), x + 200, y + 0.5]} for x, y, t in sorted(spots, key=lambda s: s[1])]

    (tmp_path / "two.pdf").write_bytes(b"abcd|efgh")
    found = files.read_elements(spark, str(tmp_path), ("pdf",), {"pdf": pages})
    spots = found.select("doc_id", "page", "text", *[F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    ordered = layout.reading_order(spots, ["doc_id", "page"]).orderBy("pos").collect()
    assert "".join(r["text"] for r in ordered) == "abcdefgh"


def test_stream_takes_each_file_once(spark, tmp_path):
    source, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.txt").write_text("one")
    assert ingest.ingest_available(spark, str(source), table, mark).count() == 1
    (source / "b.txt").write_text("two\n\nthree")
    assert ingest.ingest_available(spark, str(source), table, mark).count() == 3
    assert ingest.ingest_available(spark, str(source), table, mark).count() == 3


def test_file_index(spark, tmp_path):
    t, c = spark.createDataFrame([("t1", "n")], "id string, name string"), spark.createDataFrame([("t1", 0, [1.0])], "template_id string, vec_offset long, embedding array<float>")
    index.write_index(str(tmp_path), t, c)
    names, chunks = index.read_index(spark, str(tmp_path), "id string, name string")
    assert [tuple(r) for r in names.collect()] == [("t1", "n")] and chunks.first()["embedding"] == [1.0]
    assert index.has_column(t, "name") and not index.has_column(t, "x")
