"""Cases that the tables don't hold, over literal rows."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import drift, logs, profile, scoring
from tidemark.sources import readers

NAN = float("nan")


def test_deviation_cases(spark):
    rows = [(NAN, 1.0, 3.0, 0.0), (None, 1.0, 3.0, 0.0), (5.0, 5.0, 5.0, 0.0), (5.1, 5.0, 5.0, 1.0), (9.0, 1.0, 3.0, 0.0), (11.0, 1.0, 3.0, 1.0), (-6.0, 1.0, 3.0, 0.5), (-5.0, 1.0, 3.0, 0.0)]
    frame = spark.createDataFrame(rows, "v double, q1 double, q3 double, d double")
    assert all(r[0] == r[1] for r in frame.select(scoring.deviation(F.col("v"), F.col("q1"), F.col("q3")), "d").collect())
    word = spark.createDataFrame([("c", 1.0), ("a", 0.0), (None, 0.0)], "v string, d double")
    assert all(r[0] == r[1] for r in word.select(scoring.unknown(F.col("v"), F.array(F.lit("a"), F.lit("b"))), "d").collect())


def test_row_scores_of_several_features(spark):
    events = spark.createDataFrame([(1, "p", 100.0, 5.0, "new"), (2, "p", None, NAN, None), (3, "q", 100.0, 5.0, "new"), (4, "p", 2.0, 5.0, "a")], "id long, project string, x double, y double, c string")
    fences = spark.createDataFrame([("p", "x", "continuous", 1.0, 3.0, None), ("p", "y", "continuous", 5.0, 5.0, None), ("p", "c", "categorical", None, None, "a"), ("p", "z", "continuous", 0.0, 0.0, None)], "project string, feature string, kind string, q1 double, q3 double, value string")
    for narrow in (0, 5):
        got = {r["id"]: (r["score"], r["is_ood"], r["deviations"]) for r in logs.score_events(events, "project", ["x", "y", "c"], fences, narrow).collect()}
        assert got == {1: (45.5, 1, {"c": 1.0, "x": 45.5}), 2: (0.0, 0, {}), 3: (0.0, 0, {}), 4: (0.0, 0, {})}


def test_scores_of_repeated_ids_and_clashing_names(spark):
    """Rows with one id, in one project and in two, null projects, names that the operator uses itself."""
    rows = [(1, "p", 100.0, 'a"b', 7), (1, "q", 2.0, "new", 7), (1, "p", 2.0, "new", 8), (1, None, 900.0, "new", 9), (2, "r", 900.0, "x", 9)]
    events = spark.createDataFrame(rows, 'id long, project string, `x.y` double, `c"` string, __fences int')
    fences = spark.createDataFrame([(p, f, k, a, b, v) for p in ("p", "q") for f, k, a, b, v in (("x.y", "continuous", 1.0, 3.0, None), ("x.y", "continuous", 1.0, 3.0, None), ('c"', "categorical", None, None, 'a"b'), ('c"', "categorical", None, None, None))], "project string, feature string, kind string, q1 double, q3 double, value string")
    for narrow, most in ((0, 9), (9, 9), (9, 0), (0, 0)):
        scored = logs.score_events(events, "project", ["x.y", 'c"'], fences, narrow, most)
        assert scored.columns == [*events.columns, "score", "is_ood", "deviations"]
        got = sorted((str(r["project"]), r["x.y"], r["score"], tuple(sorted(r["deviations"].items()))) for r in scored.collect())
        assert got == [("None", 900.0, 0.0, ()), ("p", 2.0, 1.0, (('c"', 1.0),)), ("p", 100.0, 45.5, (("x.y", 45.5),)), ("q", 2.0, 1.0, (('c"', 1.0),)), ("r", 900.0, 0.0, ())]
    assert logs.score_events(events, "project", ["x.y"], fences.limit(0)).agg(F.sum("is_ood")).first()[0] == 0
    assert logs.score_events(events, "project", [], fences).count() == 5


def test_events_are_not_shuffled(spark):
    events = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("project"), F.rand(1).alias("x"), F.lit("a").alias("c"))
    fences = logs.project_fences(events, "project", ["x", "c"])
    plan = logs.score_events(events, "project", ["x", "c"], fences)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and not any("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_merged_maps(spark):
    frame = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"x": 1}), ({"y": 1}, None), (None, None)], "o map<string,int>, n map<string,int>")
    assert [r[0] for r in frame.select(logs.merged_maps(F.col("o"), F.col("n"))).collect()] == [{"a": 1, "b": 3, "c": 4}, {"x": 1}, {"y": 1}, {}]


def counted(spark, old, new, kind):
    rows = [(v, True) for v in old] + [(v, False) for v in new]
    frame = spark.createDataFrame([(v, s) for v, s in rows], f"f {kind}, ref boolean")
    return (drift.category_counts if kind == "string" else drift.numeric_counts)(frame, ["f"], F.col("ref"))


def test_ks_and_psi_cases(spark):
    assert drift.ks(counted(spark, [1.0, 1.0, 2.0, 2.0], [1.0, 2.0, 2.0, 2.0], "double")).first()["statistic"] == 0.25
    same = drift.ks(counted(spark, [1.0, NAN, None], [1.0], "double")).first()
    assert (same["statistic"], same["n_ref"]) == (0.0, 1)
    apart = counted(spark, [float(k) for k in range(8)], [float(k) for k in range(10, 18)], "double")
    exact = drift.ks(apart, exact=True).first()
    assert exact["statistic"] == 1.0 and math.isclose(exact["p_value"], 2 / math.comb(16, 8), rel_tol=1e-9)
    assert drift.ks(counted(spark, [1.0], [], "double")).count() == 0
    psi = drift.psi(counted(spark, ["a", None], ["b"], "string")).first()["statistic"]
    assert math.isclose(psi, 2 * (1 - 0.0001) * math.log(1 / 0.0001), rel_tol=1e-12)
    frame = spark.createDataFrame([(3.0,), (3.5,), (NAN,), (None,)], "f double")
    assert sorted(r["v"] for r in drift.category_counts(frame, ["f"]).collect()) == ["3", "3.5"]


def test_exact_tail_against_all_orders():
    from itertools import combinations

    for n, m in ((4, 4), (5, 3), (6, 2)):
        found = []
        for some in combinations(range(n + m), n):
            a = b = top = 0
            for k in range(n + m):
                a, b = a + (k in some), b + (k not in some)
                top = max(top, abs(a * m - b * n))
            found.append(top)
        for d in {x for x in found if x}:
            assert math.isclose(tails.exact_ks_tail(d / (n * m), n, m), sum(x >= d for x in found) / len(found), abs_tol=1e-12)


def test_chi_square_tail():
    assert math.isclose(tails.chi_square_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.chi_square_tail(7.814727903251179, 3), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.chi_square_tail(9.487729036781154, 4), 0.05, rel_tol=1e-9)
    assert tails.chi_square_tail(0.0, 5) == 1.0


def test_burst_cases(spark):
    flags = {"three": [1, 1, 1] + [0] * 7, "four": [1, 1, 1, 1] + [0] * 6, "one": [1], "old": [1] * 10 + [0] * 10}
    rows = [(p, k, f) for p, fs in flags.items() for k, f in enumerate(fs)]
    frame = spark.createDataFrame(rows, "project string, at int, is_ood int")
    got = {r["project"]: (r["system_status"], r["drift_ratio"]) for r in logs.project_health(spark.createDataFrame([(p,) for p in [*flags, "none"]], "project string"), frame, ["at"]).collect()}
    assert got == {"three": ("Healthy", 0.3), "four": ("Degraded", 0.4), "one": ("Degraded", 1.0), "old": ("Healthy", 0.0), "none": ("Healthy", 0.0)}


def test_judged_defaults(spark):
    got = logs.judged(spark.createDataFrame([("a", True), ("b", True)], "feature string, truth boolean"), spark.createDataFrame([("b", True), ("c", True)], "feature string, detected boolean"))
    assert {tuple(r) for r in got.collect()} == {("a", True, False), ("b", True, True), ("c", False, True)}


def test_cusum_against_its_recursion(spark):
    rows = [(k % 2, k, float((k * 37) % 23) - 11) for k in range(200)]
    got = {r["k"]: (r["high"], r["low"]) for r in logs.cusum(spark.createDataFrame(rows, "g int, k int, v double").repartition(7), "g", ["k"], F.col("v"), F.lit(0.5), F.lit(1.0)).collect()}
    for g in (0, 1):
        high = low = 0.0
        for _, k, v in (r for r in rows if r[0] == g):
            high, low = max(0.0, high + v - 1.5), max(0.0, low - v - 0.5)
            assert got[k] == pytest.approx((high, low))


def test_quoted_text(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c\n1,"say ""hi"" now",NA\n2,"two\nlines",3.5\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "q.csv")).orderBy("a").collect()] == [(1, 'say "hi" now', None), (2, "two\nlines", 3.5)]
    (tmp_path / "w.csv").write_bytes("a,b\n1,€5 “q”\n".encode("cp1252"))
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "w.csv")).collect()] == [(1, "€5 “q”")]
    (tmp_path / "r.arff").write_text("@relation r\n@attribute place string\n@attribute n numeric\n@data\n@home,1\nwork,2\n")
    assert {tuple(r) for r in readers.read(spark, str(tmp_path / "r.arff")).collect()} == {("@home", 1.0), ("work", 2.0)}
    (tmp_path / "s.dat").write_text("1 1:2 1:3 2:5\n-1 2:1\n")
    assert {tuple(r) for r in readers.read(spark, str(tmp_path / "s.dat")).collect()} == {(3.0, 5.0), (None, 1.0)}


def test_profile_labels(spark):
    """A column for each rule of the cascade, built so that this rule is the first that holds."""
    n = 120
    columns = {
        "hole": ("double", lambda k: None, "empty", "ignore"),
        "flat": ("string", lambda k: "on", "near_constant", "ignore"),
        "when": ("timestamp", lambda k: datetime(2020, 1, 1 + k * 7 % 28), "datetime", "ignore"),
        "rising": ("double", lambda k: k * k / 7, "monotonic", "ignore"),
        "colour": ("string", lambda k: ("red", "green", "blue")[k * 7 % 3], "few_texts", "categorical"),
        "wheels": ("int", lambda k: k * 5 % 4, "few_integers", "categorical"),
        "weight": ("double", lambda k: (k * 37 % n) / 3, "numbers", "continuous"),
        "part": ("string", lambda k: f"ZX{k * 37 % n:03d}-Q{k * 11 % n:03d}", "code", "ignore"),
        "mail": ("string", lambda k: f"user {k * 37 % n} of {n}", "identifier", "ignore"),
        "note": ("string", lambda k: "so many words " * (1 + k * 37 % 80), "free_text", "ignore"),
        "tag": ("string", lambda k: f"t{k * 7 % 55}", "unclear", "review"),
        "order": ("int", lambda k: k, "monotonic", "ignore"),
    }
    rows = [tuple(make(k) for _, make, _, _ in columns.values()) for k in range(n)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, (t, *_) in columns.items()))
    got = {r["name"]: (r["reason_code"], r["decision"]) for r in profile.profile(frame, "order").collect()}
    assert got == {c: (why, kind) for c, (_, _, why, kind) in columns.items()}
    flags = profile.profile(spark.createDataFrame([(k % 2 == 0, k) for k in range(10)], "flag boolean, n int")).where("name = 'flag'").first()
    assert (flags["decision"], flags["best_guess"]) == ("review", "ignore")
