"""Profiles of folders and by sketches, densities and exact tails against slow versions."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import densities, folders, profile

SF = "/root/testdata/sf0.001"


def test_a_folder_of_odd_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "rise.csv").write_text("k,c,text\n" + "".join(f"{k},{k % 3},w{k * 7 % 300}\n" + "k,c,text\n" * (k == 5) for k in range(300)))
    (tmp_path / "a" / "b" / "semi.CSV").write_text("x;y\n1;2\n")
    (tmp_path / "a" / "b" / "semi.csv").write_text("x;x; \n1;2,5;NA\n\n" + "1.0;nan;\n" * 3 + '"1";"a;b"\n')
    (tmp_path / "head.csv").write_text("only,names\n")
    (tmp_path / "note.txt").write_text("no,table\n1,2\n")
    (tmp_path / "none.csv").write_text("")
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            got = {(r["file"].rsplit("/", 1)[-1], r["name"]): r for r in folders.profile_files(spark, f"file://{tmp_path}").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert set(got) == {("rise.csv", n) for n in ("k", "c", "text")} | {("semi.csv", n) for n in ("x", "x.1", "_c2")} | {("head.csv", n) for n in ("only", "names")}
        rise = got["rise.csv", "k"]
        assert (rise["kind"], rise["n_rows"], rise["n_unique"], rise["reason_code"]) == ("float", 301, 300, "monotonic")  # the line like the header is a row
        assert got["rise.csv", "c"]["n_unique"] == 3 and got["rise.csv", "text"]["kind"] == "text" and not got["rise.csv", "text"]["monotonic"]
        first, second, third = (got["semi.csv", n] for n in ("x", "x.1", "_c2"))
        assert (first["n_rows"], first["n_unique"], first["dominant_ratio"], first["reason_code"]) == (5, 1, 1.0, "near_constant")
        assert (second["n_values"], second["n_unique"], second["kind"]) == (2, 2, "text") and third["reason_code"] == got["head.csv", "only"]["reason_code"] == "empty"
    assert folders.profile_files(spark, f"file://{tmp_path}", "*.none").count() == 0


def test_files_of_a_folder_as_one_table(spark, tmp_path):
    rows = spark.range(500).select("id", (F.col("id") % 60).cast("string").alias("t"), F.rand(3).alias("x"))
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").write.option("header", True).csv(f"file://{tmp_path}/table")
    got = {r["name"]: r for r in folders.profile_files(spark, f"file://{tmp_path}", by_folder=True).collect()}
    want = {r["name"]: r for r in profile.profile(rows.withColumn("t", F.col("t").cast("int")), "id").collect()}
    for name, r in want.items():
        assert all(got[name][c] == pytest.approx(r[c]) for c in ("n_rows", "n_unique", "reason_code", "decision", "monotonic", "cardinality_ratio", "dominant_ratio", "value_range")), name


def test_many_columns_plan_in_seconds(spark):
    wide = spark.range(2000).select("id", *[(F.col("id") * (k + 1) % 97).alias(f"c{k}") for k in range(300)])
    start = time.time()
    out = profile.profile(wide, "id", sketches=True)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - start < 60 and len(out.columns) > 10
    codes = {r["name"]: (r["reason_code"], r["n_unique"]) for r in out.collect()}
    assert codes["id"][0] == "monotonic" and all(code == "numbers" and abs(n - 97) <= 1 for name, (code, n) in codes.items() if name not in ("id", "c96", "c193", "c290"))
    assert codes["c96"] == ("near_constant", 1)


def test_sketches_hold_nulls_and_rare_values(spark):
    frame = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("mostly"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") == 7, "odd").otherwise("even").alias("flat"))
    exact, rough = ({r["name"]: r for r in profile.profile(frame, sketches=s).collect()} for s in (False, True))
    for name, r in exact.items():
        assert rough[name]["reason_code"] == r["reason_code"] and rough[name]["n_values"] == r["n_values"]
        assert rough[name]["n_unique"] == pytest.approx(r["n_unique"], rel=0.03) and rough[name]["dominant_ratio"] == pytest.approx(r["dominant_ratio"], abs=0.01)


def test_binned_density_is_the_sum(spark):
    rng = np.random.default_rng(5)
    values = {"even": rng.normal(3, 2, 400), "heavy": rng.standard_cauchy(300) * 50, "few": np.repeat([1.0, 2.0, 10.0], [5, 1, 1]), "flat": np.full(9, 4.0)}
    counts = spark.createDataFrame([(f, float(v), 0, 1) for f, vs in values.items() for v in vs], "feature string, v double, n_ref long, n_prod long")
    normals = spark.createDataFrame([(f, 1.0, 2.0) for f in values], "feature string, mu double, sigma double")
    got = {}
    for r in densities.kernel_density(counts, densities.grids(counts, normals, 50)).collect():
        got.setdefault(r["feature"], []).append((r["x"], r["density"]))
    assert set(got) == {"even", "heavy", "few"}
    for f, points in got.items():
        v = values[f]
        h = v.std(ddof=1) * len(v) ** -0.2
        for x, density in points:
            assert density == pytest.approx(np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)), abs=1e-9 / h)


def slow_tail(d, n, m):
    """Paths counted one by one with whole numbers."""
    limit, paths = round(d * n * m), [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(i * m - j * n) < limit:
                paths[i][j] = 1 if i == j == 0 else (paths[i - 1][j] if i else 0) + (paths[i][j - 1] if j else 0)
    return 1 - paths[n][m] / math.comb(n + m, n)


def test_exact_tails_of_hundreds_and_thousands():
    for n, m in ((100, 100), (100, 73), (1, 40), (57, 1), (300, 200)):
        for k in (1, 3, 8, 13, 20, 60):
            d = round(k / 60 * n * m) / (n * m)
            assert tails.exact_ks_tail(d, n, m) == pytest.approx(slow_tail(d, n, m), abs=1e-10), (n, m, d)
    start = time.time()
    assert tails.exact_ks_tail(0.02, 10_000, 10_000) == pytest.approx(0.0366, abs=2e-3) and tails.exact_ks_tail(0.02, 10_000, 9_999) == pytest.approx(0.0366, abs=2e-3)
    assert time.time() - start < 10 and tails.exact_ks_tail(1.0, 10_000, 10_000) == pytest.approx(0.0, abs=1e-10) and tails.exact_ks_tail(0.0, 5, 5) == 1.0
