"""Batches drawn by hash: the right rows, and only about as many sorted and sent as are drawn."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import trials
from tidemark.plans import studies


def first_keys(keys, size, trial):
    return sorted(sorted(keys, key=lambda k: (hashlib.md5(f"{k}|{trial}".encode()).hexdigest(), k))[:size])


@pytest.mark.parametrize(
    "keys",
    [list(range(20_000)), [k % 7_000 for k in range(20_000)], [5] * 19_000 + list(range(10, 1_010)), list(range(300))],
    ids=["distinct", "repeated", "one key of most rows", "fewer than the batch"],
)
def test_draw_against_brute_force(spark, keys):
    pool = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = trials.draw(pool, "k", 500, 6, first=4).collect()
    for trial in range(4, 10):
        mine = [r for r in rows if r["trial"] == trial]
        assert sorted(r["k"] for r in mine) == first_keys(keys, 500, trial)
        assert sorted(r["r"] for r in mine) == list(range(1, len(mine) + 1))


def shuffled_rows(spark):
    """Rows that the session's stages have sent so far, by stage."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_rows_beyond_a_batch_are_not_sent(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 97).cast("double").alias("v"), (F.col("id") < 1_000).alias("ref"))
    before = shuffled_rows(spark)
    found = trials.run(df, "id", ["v"], F.col("ref"), [(2_000, 0.0, 1.0)], 8).collect()
    sent = sum(n for k, n in shuffled_rows(spark).items() if k not in before)
    assert len(found) == 8
    assert sent < 60_000  # 8 trials of 2,000 rows; each trial sent all 59,000 before


@pytest.mark.parametrize("name", ["val3_confusion", "val3_whole_study"])
def test_studies_of_batches_far_smaller_than_the_table(spark, tmp_path, monkeypatch, name):
    db = duckdb.connect()
    db.execute("CREATE TABLE lineitem AS SELECT * REPLACE (row_number() OVER () AS l_orderkey) FROM '/root/testdata/sf0.01/lineitem.parquet'")  # no key twice
    db.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    monkeypatch.setattr(studies, "SIZE", 1_500)
    monkeypatch.setattr(studies, "TRIALS", 6)
    sql = entry.oracle_sql()[name].replace("r <= 25000", "r <= 1500").replace("range(1, 16)", "range(1, 7)")
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    before = shuffled_rows(spark)
    got = [plain(r[c] for c in names) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    sent = sum(n for k, n in shuffled_rows(spark).items() if k not in before)
    assert sorted(got, key=repr) == sorted(map(plain, result.fetchall()), key=repr)
    assert sent < 500_000  # 1,041,962 before rows beyond the batches went first
