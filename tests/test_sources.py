"""Text files as expressions, the registered source of elements, and incremental classification."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators import tfidf
from clausewise.sources import files, reader, text_files
from clausewise.streaming import classify

DAY = datetime.date(2025, 1, 1)


def python_text(content):
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("cp1251")
    return [p.strip() for p in text.split("\n\n") if p.strip()]


def test_bytes_are_decoded_as_python_decodes_them(spark):
    rng = np.random.default_rng(3)
    given = [b"", b"\n\n", b"plain", "договор № 7".encode(), "договор № 7 – «да»".encode("cp1251"), b"\xff\x98", b"a\x98\xff", bytes(b for b in range(256) if b != 0x98), b"\xef\xbb\xbfmark", b"a\n\n\n\nb\n \n\nc"]
    given += [bytes(rng.integers(32, 256, rng.integers(1, 60)).tolist()) for _ in range(200)]
    rows = [(f"/in/{k:04d}.txt", bytearray(x)) for k, x in enumerate(given)]
    got = {}
    for r in files.elements(spark.createDataFrame(rows, "path string, content binary")).orderBy("doc_id", "order").collect():
        got.setdefault(int(r["doc_id"]), []).append((r["text"], r["parse_error"]))
    for k, x in enumerate(given):
        try:
            want = [(p, None) for p in python_text(x)]
        except UnicodeDecodeError as e:
            want = [(None, f"UnicodeDecodeError: {e}")]
        assert got.get(k, []) == want, x


def test_text_is_planned_without_python(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    plan = files.read_elements(spark, str(tmp_path), ("txt",))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    assert "MapInArrow" in files.read_elements(spark, str(tmp_path), ("txt", "docx"))._jdf.queryExecution().executedPlan().toString()


def test_encoded_is_the_inverse_of_decoded(spark):
    text = text_files.SECOND + "abc №"
    row = spark.createDataFrame([(text,)], "t string").select(text_files.decoded(text_files.encoded(F.col("t"))).alias("r")).first()
    assert row["r"]["text"] == text and row["r"]["error"] is None


@pytest.fixture
def folder(tmp_path):
    for k in range(12):
        place = tmp_path / "in" / f"kind{k % 3}" / ("deep" if k % 2 else "")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f{k}.{'txt' if k % 4 else 'docx'}").write_bytes(f"part {k}\n\nmore {'x' * 100 * k}".encode() if k != 5 else "договор".encode("cp1251"))
    (tmp_path / "in" / "noted.md").write_text("not asked for")
    (tmp_path / "in" / "_hidden").mkdir()
    (tmp_path / "in" / "_hidden" / "h.txt").write_text("h")
    return str(tmp_path / "in")


def shown(df):
    return sorted(str((r["doc_key"], r["doc_path"], r["category"], r["order"], r["text"], r["parse_error"])) for r in df.collect())


def test_the_source_reads_what_read_elements_reads(spark, folder):
    reader.register(spark)
    for size in (1, 700, 1 << 30):
        assert shown(spark.read.format(reader.NAME).option("partitionBytes", size).load(folder)) == shown(files.read_elements(spark, folder))
    assert spark.read.format(reader.NAME).option("partitionBytes", 1).load(folder).rdd.getNumPartitions() == 12
    assert spark.read.format(reader.NAME).load(folder).rdd.getNumPartitions() == 1
    assert spark.read.format(reader.NAME).load(folder + "/none").count() == 0


def test_filters_reach_the_list_of_files(spark, folder):
    reader.register(spark)
    df = spark.read.format(reader.NAME).option("partitionBytes", 1).load(folder)
    some = df.filter("category = 'kind0' AND source_type IN ('txt', 'pdf') AND text LIKE 'part%'")
    want = files.read_elements(spark, folder).filter("category = 'kind0' AND source_type = 'txt' AND text LIKE 'part%'")
    assert shown(some) == shown(want) and some.count()
    assert df.filter("source_type = 'docx'").rdd.getNumPartitions() == 3
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "BatchScan" not in line]
    assert all("category" not in line and "source_type" not in line for line in filters) and any("StartsWith" in line or "text" in line for line in filters)


def test_the_source_streams_each_file_once(spark, folder, tmp_path):
    reader.register(spark)

    def run():
        rows = spark.readStream.format(reader.NAME).option("partitionBytes", 500).load(folder)
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(files.ELEMENTS).parquet(str(tmp_path / "out"))

    assert shown(run()) == shown(files.read_elements(spark, folder))
    time.sleep(0.05)
    with open(folder + "/kind0/later.txt", "w") as f:
        f.write("late")
    assert shown(run()) == shown(files.read_elements(spark, folder)) == shown(run())


def arrivals(spark, rows, place):
    spark.createDataFrame([(p, bytearray(x)) for p, x in rows], "path string, content binary").coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema("path string, content binary").parquet(place)


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    library = spark.createDataFrame([("t1", "red apples and pears"), ("t2", "long contract of supply")], "id string, text string")
    model = tfidf.fit(library, key="id")
    templates = tfidf.transform(library, "text", "embedding", model)
    vectors = lambda df: tfidf.transform(df, "text", "embedding", model)
    rows = [(f"/in/s{k % 3}/{k}.txt", (["red apples", "a contract of supply", "nothing known", ""][k % 4] + f" {'договор' if k % 2 else ''}").encode()) for k in range(20)]
    rows += [("/in/s1/bad.txt", b"\xff\x98")]

    def run(name, batches):
        for b in batches:
            stream = arrivals(spark, b, str(tmp_path / name / "landing"))
            classify.classify_available(stream, templates, vectors, str(tmp_path / name / "out"), str(tmp_path / name / "mark"), DAY)
        found = classify.results(spark, str(tmp_path / name / "out"))
        return sorted(map(str, found.collect())), sorted(map(str, classify.counters(spark, str(tmp_path / name / "out")).collect()))

    one = run("one", [rows])
    assert run("two", [rows[:9], rows[5:] + rows[:2]]) == one  # late files come again, with a restart between
    assert run("three", [rows[:3], [("/in/s9/x.txt", b"red")], rows[3:]])[0] != one[0]
    direct = classify.classified(spark.createDataFrame([(p, bytearray(x)) for p, x in rows + rows[:4]], "path string, content binary"), templates, vectors, DAY)
    assert sorted(map(str, direct.collect())) == one[0] and len(one[0]) == 21
    assert sorted(map(str, classify.counted(direct).collect())) == one[1]


def test_a_library_that_is_too_large_to_be_sent_is_dealt(spark, tmp_path):
    library = spark.createDataFrame([(f"t{k}", f"red apples and pears {'supply ' * (k % 3)}") for k in range(9)], "id string, text string")
    model = tfidf.fit(library, key="id")
    rows = [(f"/in/s{k % 2}/{k}.txt", b"red apples and supply" if k % 2 else b"nothing known") for k in range(8)]
    found = []
    for name, make, most in (("a", tfidf.transform, 1 << 20), ("b", tfidf.transform, 100), ("c", tfidf.sparse, 100), ("d", tfidf.sparse, 1 << 20)):
        vectors = lambda df, make=make: make(df, "text", "embedding", model)
        stream = arrivals(spark, rows, str(tmp_path / name / "landing"))
        classify.classify_available(stream, vectors(library), vectors, str(tmp_path / name / "out"), str(tmp_path / name / "mark"), DAY, block_bytes=most)
        found.append(sorted(map(str, classify.results(spark, str(tmp_path / name / "out")).collect())))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 8


def test_a_run_that_failed_is_taken_up_again(spark, tmp_path):
    library = spark.createDataFrame([("t1", "red apples")], "id string, text string")
    model = tfidf.fit(library, key="id")
    templates = tfidf.transform(library, "text", "embedding", model)
    good = lambda df: tfidf.transform(df, "text", "embedding", model)
    rows = [(f"/in/s{k % 2}/{k}.txt", b"red apples %d" % k) for k in range(6)]

    @F.udf("string")
    def fails(x):
        raise RuntimeError("lost")

    stream = arrivals(spark, rows, str(tmp_path / "landing"))
    run = lambda vectors: classify.classify_available(stream, templates, vectors, str(tmp_path / "out"), str(tmp_path / "mark"), DAY)
    with pytest.raises(Exception, match="lost"):
        run(lambda df: good(df.withColumn("text", fails("text"))))
    run(good)
    run(good)
    assert classify.results(spark, str(tmp_path / "out")).count() == 6
    assert sorted((r["session"], r["processed"], r["classified"]) for r in classify.counters(spark, str(tmp_path / "out")).collect()) == [("s0", 3, 3), ("s1", 3, 3)]
