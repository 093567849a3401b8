import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, scoring
from tidemark.sources import readers
from tidemark.sources.tables import Store
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_readers(spark, tmp_path):
    text = "a;b\n1;x\n2;y\n"
    (tmp_path / "t.csv").write_text(text)
    (tmp_path / "t.tsv").write_text(text.replace(";", "\t"))
    (tmp_path / "latin.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/one.csv", text)
        z.writestr("two.csv", "no")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("folder/", "")
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    (tmp_path / "cols.json").write_text('{"a": [1, 2], "b": ["x", "y"]}')
    (tmp_path / "t.arff").write_text("% note\n@RELATION r\n@ATTRIBUTE 'a b' numeric\n@ATTRIBUTE b {x,y}\n@DATA\n\n1, 'x, z'\n2, y\n")
    (tmp_path / "svm.dat").write_text("1 1:0.5 3:2\nnothing\n-1 2:1\n")
    (tmp_path / "plain.dat").write_text("1 x\n2   y\n")
    expected = [(1, "x"), (2, "y")]
    for name in ("t.csv", "t.tsv", "t.csv.gz", "t.zip", "t.jsonl", "t.json", "cols.json", "plain.dat"):
        assert sorted(rows(readers.read(spark, str(tmp_path / name)))) == expected, name
    assert rows(readers.read(spark, str(tmp_path / "latin.csv"))) == [(1, "é")]
    arff = readers.read(spark, str(tmp_path / "t.arff"))
    assert arff.columns == ["a b", "b"] and sorted(rows(arff)) == [(1.0, "x, z"), (2.0, "y")]
    svm = readers.read(spark, str(tmp_path / "svm.dat"))
    assert svm.columns == ["Sensor_1", "Sensor_2", "Sensor_3"] and rows(svm) == [(0.5, None, 2.0), (None, 1.0, None)]
    both = readers.read_all(spark, [str(tmp_path / "t.csv"), f"{SF}/region.parquet"])
    assert both.count() == 2 + spark.read.parquet(f"{SF}/region.parquet").count() and "a" in both.columns
    with pytest.raises(Exception, match="holds no file"):
        readers.read(spark, str(tmp_path / "empty.zip")).collect()


def test_profile_cases(spark):
    rows = [(i, f"U{i:03d}", None, str(i % 3) if i else "n/a", f"ABC-{i:04d}", float("nan") if i == 4 else i * 0.5, 7, i, (i * 37) % 101) for i in range(101)]
    frame = spark.createDataFrame(rows, "id int, name string, blank string, num string, code string, x double, same int, time int, mixed int")
    shuffled = {r["name"]: r for r in profile.profile(frame).collect()}
    assert {n: r["reason_code"] for n, r in shuffled.items()} == {
        "id": "numbers", "name": "identifier", "blank": "empty", "num": "numbers", "code": "code", "x": "numbers", "same": "near_constant", "time": "time_index", "mixed": "numbers",
    }
    assert shuffled["blank"]["dominant_ratio"] == 1.0 and shuffled["x"]["n_values"] == 100 and shuffled["num"]["kind"] == "float"
    ordered = {r["name"]: r["reason_code"] for r in profile.profile(frame, "id").collect()}
    assert ordered["id"] == ordered["name"] == ordered["code"] == "monotonic" and ordered["mixed"] == "numbers"
    overrides = spark.createDataFrame([("mixed", "ignore"), ("same", "categorical")], "name string, role string")
    assert {tuple(r) for r in profile.routes(profile.profile(frame), overrides).collect()} == {("id", "continuous"), ("num", "continuous"), ("x", "continuous"), ("same", "categorical")}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    old, new = items.where("l_shipdate < '1996-01-01'"), items.where("l_shipdate >= '1996-01-01'")
    assert store.baseline("p 1").count() == 0
    store.upsert_projects(spark.createDataFrame([("p 1", "one", "a"), ("p2", "two", "a")], "id string, name string, owner string"))
    store.upsert_projects(spark.createDataFrame([("p 1", "one", "b")], "id string, name string, owner string"))
    assert rows(store.projects("a")) == [("p2",)] and rows(store.projects("b")) == [("p 1",)]
    store.lock_baseline("p 1", old, ["l_quantity", "l_linestatus"], ["l_linestatus"])
    store.lock_baseline("p2", old, ["l_tax"])
    store.lock_baseline("p 1", old, ["l_quantity"], ["l_linestatus"])
    assert {r["feature"] for r in store.fences("p 1").collect()} == {"l_quantity", "l_linestatus"} and store.fences("p2").count() == 1
    assert store.baseline("p 1").agg(F.sum("n")).first()[0] == 2 * old.count()
    report = {r["feature"]: r for r in store.report("p 1", new).collect()}
    assert set(report) == {"l_quantity", "l_linestatus"} and report["l_quantity"]["n_prod"] == new.count()
    moved = new.withColumn("l_quantity", F.col("l_quantity") + 100)
    store.alert("p 1", store.report("p 1", old))
    assert store.table("alerts").count() == 0
    streams.drift_batches(store, "p 1")(moved, 0)
    alert = store.table("alerts").collect()
    assert len(alert) == 1 and alert[0]["owner"] == "b" and "l_quantity" in alert[0]["features"]
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("score", F.lit(0.0)).withColumn("is_ood", F.lit(0))
    store.append_logs(events, ["value", "event_type"], "event_id", "ts", F.lit("p 1"))
    assert store.logs("p 1", 10).count() == 10 and store.logs("p 1").count() == events.count()
    newest = store.logs("p 1", 1).first()
    assert scoring.flattened(store.logs("p 1"), "input_data", ["event_type"]).where("event_type IS NULL").count() == 0 and newest["event_time"] == events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    store.delete("p%201")
    assert store.logs("p 1").count() == store.baseline("p 1").count() == store.fences("p 1").count() == 0
    assert store.fences("p2").count() == 1 and rows(store.projects("b")) == []


def replay(spark, tmp_path, frame, make, mode):
    """Runs a stream over ``frame`` cut into three files and returns the rows of its memory sink."""
    folder = f"{tmp_path}/{mode}"
    frame.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = make(stream).writeStream.format("memory").queryName(f"sink_{mode}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/state-{mode}").trigger(availableNow=True).start()
    run.awaitTermination(180)
    return spark.table(f"sink_{mode}")


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 12")
    score = [scoring.deviation(F.col("value"), F.lit(40.0), F.lit(60.0))]
    batch = scoring.with_score(events, score)
    expected = {tuple(r) for r in scoring.health(batch, "user_id", ["ts", "event_id"]).collect()}
    got = {}
    for r in replay(spark, tmp_path, events, lambda s: streams.burst_stream(streams.score_stream(s, score), "user_id", "ts", "event_id"), "update").collect():
        got[r["user_id"]] = tuple(r)  # the memory sink keeps the order of batches
    assert set(got) == {e[0] for e in expected}
    assert {(k, round(v[1], 9), v[2]) for k, v in got.items()} == {(a, round(b, 9), c) for a, b, c in expected}
    rates = replay(spark, tmp_path, events, lambda s: streams.anomaly_rates(streams.score_stream(s, score), "ts", ["event_type"], "1 day", "400 days"), "complete")
    whole = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n")).collect()
    assert {(r["start"], r["event_type"], r["n_logs"]) for r in rates.collect()} == {tuple(r) for r in whole}


def test_line_breaks_over_many_ranges(spark, tmp_path):
    """Records that cross the ranges of a file, stray quotes inside fields, blank lines, a header over two lines, two files."""
    rng = random.Random(1)
    expected = []
    for f in range(2):
        rows = [(f * 10_000 + k, rng.choice(['5" pipe', "plain", "NA", 'say ""hi""', "a\nb", 'x\n\n"",""\n"";y', "é\n€", "tail\n", "", "a,b"]) + ("" if rng.random() < 0.9 else " z"), rng.choice(["1.5", "2", ""])) for k in range(3000)]
        with open(tmp_path / f"{f}.csv", "w", encoding="utf-8") as out:
            out.write('id,"two\nnames",n\n')
            for k, text, n in rows:
                cell = text if text in ("plain", "NA", "") or text.startswith('5"') else f'"{text}"'
                out.write(f"{k},{cell},{n}\n" + "\n" * (k % 7 == 0))
        expected += [(k, None if (t := text.replace('""', '"') if text[:2] != '5"' else text) in ("NA", "") else t, float(n) if n else None) for k, text, n in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = readers.delimited(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert got.columns == ["id", "two\nnames", "n"] and sorted(rows_of(got)) == sorted(expected, key=lambda r: r[0])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_text_traps(spark, tmp_path):
    (tmp_path / "pipe.csv").write_text('a,b\n1,5" pipe\n2,x "y\n')
    assert rows_of(readers.delimited(spark, str(tmp_path / "pipe.csv"))) == [(1, '5" pipe'), (2, 'x "y')]
    (tmp_path / "least.csv").write_text(f"a,b,c\n{-(1 << 63)},{-(1 << 31)},{1 << 31}\n5,5,5\n")
    assert [t for _, t in readers.delimited(spark, str(tmp_path / "least.csv")).dtypes] == ["bigint", "int", "bigint"]
    (tmp_path / "open.csv").write_text("a,b\n" + '1,"never closed\n' + "2,x\n" * 20)
    old, readers.MOST_LINES = readers.MOST_LINES, 10
    try:
        with pytest.raises(ValueError, match="not closed"):
            readers.delimited(spark, str(tmp_path / "open.csv"))
    finally:
        readers.MOST_LINES = old
    (tmp_path / "west.csv").write_bytes('a,"n€"\n1,"é\n“q”"\n'.encode("cp1252"))
    west = readers.delimited(spark, str(tmp_path / "west.csv"))
    assert west.columns == ["a", "n€"] and rows_of(west) == [(1, "é\n“q”")]


def test_json_lines_lose_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    got = readers.json(spark, str(tmp_path / "a.json"))
    assert sorted((r["a"] or 0, r["_corrupt_record"]) for r in got.collect()) == [(0, '{"a": 2'), (1, None), (3, None)]
    (tmp_path / "b.json").write_text("oops\n" * 2 + '{"a": 1}\n' * 30)
    assert readers.json(spark, str(tmp_path / "b.json")).count() == 32
    (tmp_path / "c.json").write_text('[\n{"a": 1},\n{"a": 2},\n{"a": 3}\n]')
    (tmp_path / "d.json").write_text('{\n  "a": [1, 2,\n 3],\n  "b.c": ["x", "y", "z"]\n}')
    (tmp_path / "e.json").write_text('{"a": [1, 2]}\n{"a": [3]}\n')
    assert sorted(rows_of(readers.json(spark, str(tmp_path / "c.json")))) == [(1,), (2,), (3,)]
    assert sorted(rows_of(readers.json(spark, str(tmp_path / "d.json")))) == [(1, "x"), (2, "y"), (3, "z")]
    assert sorted(r["a"] for r in readers.json(spark, str(tmp_path / "e.json")).collect()) == [[1, 2], [3]]


def test_archives(spark, tmp_path):
    def put(name, data, more=()):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("folder/", "")
            z.writestr("folder/data", data)
            for extra in more:
                z.writestr(*extra)

    put("a.zip", 'n,text\n1,"say ""hi"" now"\n2,"two\nlines"\n\n3,NA\n4,5" pipe\n5\n'.encode(), [("other.csv", "no,such\n1,2\n")])
    put("b.zip", "text;n;more\n€5 “q”;6;é\n;7;\n".encode("cp1252"))
    put("c.zip", "n,n,\n8,9,10\n".encode("utf-8-sig"))
    put("d.zip", b"")
    got = readers.read(spark, f"{tmp_path}/*.zip")
    assert got.columns == ["n", "text", "more", "n.1", "_c2"]
    assert sorted(rows_of(got)) == [(1, 'say "hi" now', None, None, None), (2, "two\nlines", None, None, None), (3, None, None, None, None), (4, '5" pipe', None, None, None), (5, None, None, None, None), (6, "€5 “q”", "é", None, None), (7, None, None, None, None), (8, None, None, 9, 10)]
    assert readers.zipped(spark, f"{tmp_path}/d.zip").count() == 0
