"""One commit over all tables: failures, other writers, old versions, repeated micro-batches."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logs, scoring
from tidemark.sources.commits import Commits, Conflict
from tidemark.sources.tables import SCHEMAS, Store
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"


def state_of(store):
    return {n: sorted(map(repr, store.table(n).collect())) for n in SCHEMAS}


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax", "l_returnflag", "l_linenumber")
    store.upsert_projects(spark.createDataFrame([("a", "A", "x"), ("b", "B", "x")], "id string, name string, owner string"))
    store.lock_baselines(items, F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b"), ["l_tax"], ["l_returnflag"])
    store.append_logs(items.limit(40).withColumns({"k": F.monotonically_increasing_id(), "t": F.current_timestamp(), "score": F.lit(0.0), "is_ood": F.lit(0)}), ["l_tax"], "k", "t", F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b"))
    store.alerts(spark.createDataFrame([("a", "f", True), ("b", "f", True), ("b", "g", False)], "project_id string, feature string, drift_detected boolean"))
    return store


@pytest.mark.parametrize("broken", ["second write", "rename"])
def test_failed_changes_leave_the_version_before(spark, store, monkeypatch, broken):
    before, version = state_of(store), store.version()
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    if broken == "rename":
        monkeypatch.setattr(Commits, "_publish", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    else:
        real, seen = Commits.write, []

        def write(self, name, rows):
            seen.append(name)
            if len(seen) > 1:  # the baselines' second table, and the projects after it
                raise OSError("lost")
            return real(self, name, rows)

        monkeypatch.setattr(Commits, "write", write)
    changes = [lambda: store.lock_baseline("a", items, ["l_quantity"], ["l_linestatus"]), lambda: store.upsert_projects(spark.createDataFrame([("a", "N", "y")], "id string, name string, owner string"))]
    for change in changes + ([lambda: store.delete("a")] if broken == "rename" else []):
        with pytest.raises(OSError):
            change()
    monkeypatch.undo()
    assert state_of(store) == before and store.version() == version
    store.lock_baseline("a", items, ["l_quantity"], ["l_linestatus"])
    assert {r["feature"] for r in store.fences("a").collect()} == {"l_quantity", "l_linestatus"} and store.fences("b").count() == 2
    assert store.version() == version + 1


def test_delete_is_one_version_and_readers_keep_theirs(store):
    version, held = store.version(), store.table("logs")
    n = held.count()
    store.delete("a")
    after = state_of(store)
    assert store.version() == version + 1 and all(not any("'a'" in r for r in rows) for rows in after.values()) and all(after.values())
    assert held.count() == n == store.at(version).table("logs").count() > store.table("logs").count()
    with pytest.raises(ValueError):
        store.at(version).delete("b")


def test_two_writers(spark, store, monkeypatch):
    """A writer that finds its number taken reads the newer version and makes its change there."""
    other, real, calls = Store(spark, store.commits.root), Commits._publish, []

    def publish(self, number, state):
        if not calls:
            calls.append(number)
            other.delete("b")
        real(self, number, state)

    monkeypatch.setattr(Commits, "_publish", publish)
    store.upsert_projects(spark.createDataFrame([("c", "C", "x")], "id string, name string, owner string"))
    assert {r["id"] for r in store.projects("x").collect()} == {"a", "c"} and store.table("logs").where("project_id = 'b'").count() == 0
    monkeypatch.setattr(Commits, "_publish", lambda *a: (_ for _ in ()).throw(Conflict("taken")))
    with pytest.raises(Conflict):
        store.delete("a")


def test_compact_and_vacuum(spark, store):
    for owner in ("y", "z"):
        store.upsert_projects(spark.createDataFrame([("a", "A", owner)], "id string, name string, owner string"))
    store.delete("b")
    before = state_of(store)
    for name in SCHEMAS:
        store.compact(name)
    assert state_of(store) == before and all(len(e) == 1 for e in store.commits.state()["tables"].values())
    store.commits.vacuum()
    assert state_of(store) == before and [r["owner"] for r in store.table("projects").collect()] == ["z"]
    root = store.commits.root.removeprefix("file://")
    assert all(len(os.listdir(f"{root}/data/{n}")) == 1 for n in SCHEMAS) and not glob.glob(f"{root}/data/*/*/project_id=b")
    store.upsert_projects(spark.createDataFrame([("b", "B", "w")], "id string, name string, owner string"))  # a name may come back
    assert {r["id"] for r in store.projects("w").collect()} == {"b"}


def test_a_repeated_micro_batch_alerts_once(spark, tmp_path, store):
    """Spark's log of the last batch is lost, so Spark runs it again; and a failure before the commit leaves nothing."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax", "l_returnflag").withColumn("l_tax", F.col("l_tax") + 5)
    folder, state, first = f"file://{tmp_path}/in", f"{tmp_path}/state", store.table("alerts").count()
    seen = []

    def run(sink):
        streams.drained(spark.readStream.schema(items.schema).parquet(folder), f"file://{state}", sink)

    def counted(df, number):
        seen.append(number)
        streams.drift_batches(store, "a")(df, number)

    items.limit(500).write.parquet(folder)
    run(counted)
    assert store.table("alerts").count() == first + 1
    for f in glob.glob(f"{state}/commits/*0*"):
        os.remove(f)
    for f in glob.glob(f"{state}/commits/.*0*"):
        os.remove(f)
    run(counted)
    assert seen == [0, 0] and store.table("alerts").count() == first + 1
    items.limit(300).write.mode("append").parquet(folder)

    def failing(df, number):
        seen.append(number)
        real, Commits._publish = Commits._publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
        try:
            streams.drift_batches(store, "a")(df, number)
        finally:
            Commits._publish = real

    with pytest.raises(Exception, match="lost"):
        run(failing)
    assert store.table("alerts").count() == first + 1
    run(counted)
    assert seen == [0, 0, 1, 1] and store.table("alerts").count() == first + 2


def test_stream_scores_are_those_of_the_batch(spark, tmp_path, store):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value", F.concat(F.lit("u"), F.col("user_id") % 50).alias("who"))
    store.lock_baselines(events.where("event_id % 2 = 0 AND who < 'u3'"), F.col("event_type"), ["value"], ["who"])
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    scored = streams.score_by_project(stream, "event_type", ["value", "who"], store)
    streams.drained(scored, f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    want = logs.score_events(events, "event_type", ["value", "who"], store.all_fences())
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.agg(F.sum("is_ood")).first()[0] > 0
    rates = scoring.log_totals(got, ["event_type"]).collect()
    assert len(rates) == events.select("event_type").distinct().count()
