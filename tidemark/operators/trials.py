"""How well drift is detected: batches drawn by hash, shifted by known amounts, tested in one job for all trials."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.drift import ALPHA, PSI_LIMIT, category_counts, category_key, ks_p_value, numeric_counts, psi
from tidemark.operators.running import cumulative
from tidemark.scratch import discard, saved

CASE = ["trial", "size", "severity", "share"]

#: A draw's bound on hashes leaves so many standard deviations more rows than are wanted; where that was too few, it grows by GROW.
MARGIN, GROW = 6, 8


def hash_order(key: Column, seed: Column) -> Column:
    """A repeatable shuffle: sorts alike under every partitioning, and in other engines."""
    return F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if fewer) in the order of a hash of their key."""
    return df.orderBy(hash_order(F.col(key), F.lit(seed)), key).limit(n)


def shifted(df: DataFrame, column: str, severity: float) -> DataFrame:
    """``df`` with ``severity`` sample standard deviations of the column added to it."""
    sd = df.agg(F.stddev_samp(column).alias("__sd"))  # one row
    return df.crossJoin(F.broadcast(sd)).withColumn(column, F.col(column) + F.lit(float(severity)) * F.coalesce("__sd", F.lit(0.0))).drop("__sd")


def draw(pool: DataFrame, key: str, size: int, trials: int, first: int = 1) -> DataFrame:
    """``pool`` with ``trial`` and ``r``: for each trial the first ``size`` rows in the hash order of its seed, written once.

    Hashes spread evenly, so the number of rows gives a bound that the first ``size`` lie below; the others go before anything is sorted
    or sent. Where a trial finds too few (keys that repeat share a hash), all are drawn again below a larger bound, up to none.
    """
    rows = pool.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + trials - 1))).alias("trial")).withColumn("__hash", hash_order(F.col(key), F.col("trial")))
    order = Window.partitionBy("trial").orderBy("__hash", key)
    share = (size + MARGIN * math.sqrt(size) + MARGIN**2) / max(pool.count(), 1)
    while True:
        near = rows.where(F.col("__hash") < F.lit(f"{int(share * 2**52):013x}")) if share < 1 else rows
        found = saved(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).drop("__hash"), "drawn")
        if share >= 1 or found.where(F.col("r") == size).count() == trials:
            return found
        discard(found)
        share *= GROW


def run_categories(df: DataFrame, key: str, features: Sequence[str], is_reference: Column, size: int, trials: int, limit: float = PSI_LIMIT, first: int = 1, batches: DataFrame | None = None) -> DataFrame:
    """``feature, trial, statistic, drift_detected`` by the stability index of batches of ``size`` rows, drawn as in :func:`run`."""
    side = df.withColumn("__ref", is_reference)
    drawn = draw(side.where("NOT __ref").select(key, *features), key, size, trials, first) if batches is None else batches
    kinds = dict(df.dtypes)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), category_key(F.col(f), kinds[f]).alias("v")) for f in features]))
    batch = drawn.select("trial", pairs.alias("p")).select("trial", "p.*").where("v IS NOT NULL").groupBy("trial", "feature", "v").agg(F.count("*").alias("n_prod"))
    known = category_counts(side.where("__ref"), list(features)).select("feature", "v", "n_ref", F.explode(F.sequence(F.lit(first), F.lit(first + trials - 1))).alias("trial"))
    both = known.join(batch, ["trial", "feature", "v"], "full_outer").na.fill(0, ["n_ref", "n_prod"])
    return psi(both, limit, group=["trial", "feature"]).select("feature", "trial", "statistic", "drift_detected")


def run(df: DataFrame, key: str, features: Sequence[str], is_reference: Column, cases: Sequence[tuple[int, float, float]], trials: int, alpha: float = ALPHA, first: int = 1, batches: DataFrame | None = None) -> DataFrame:
    """``feature, trial, size, severity, share, statistic, p_value, drift_detected`` for each trial and case.

    A case is (batch size, shift in standard deviations of the batch, share of the batch that is shifted). Trial t, from ``first`` on,
    takes the first rows in the hash order of seed t; ``batches`` has them where :func:`draw` has drawn them already. The largest gap is
    reached at a value of the batch or just before one, so the reference is read and summed once, and each test looks up its own values.
    """
    side = df.withColumn("__ref", is_reference)
    drawn = draw(side.where("NOT __ref").select(key, *features), key, max(c[0] for c in cases), trials, first) if batches is None else batches
    every = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(float(s)).alias("severity"), F.lit(float(p)).alias("share")) for n, s, p in cases])
    rows = drawn.select("*", F.explode(every).alias("c")).select("*", "c.*").where("r <= size")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    rows = rows.select(*CASE, "r", pairs.alias("p")).select(*CASE, "r", "p.*").where("v IS NOT NULL AND NOT isnan(v)")
    sd = rows.groupBy("feature", *CASE).agg(F.stddev_samp("v").alias("sd"))
    moved = F.col("v") + F.when(F.col("r") <= F.col("share") * F.col("size"), F.col("severity") * F.coalesce("sd", F.lit(0.0))).otherwise(F.lit(0.0))
    batch = rows.join(F.broadcast(sd), ["feature", *CASE]).groupBy("feature", *CASE, moved.alias("v")).agg(F.count("*").alias("n_prod"))  # a row a case
    batch = saved(batch, "batches")
    values = batch.select("feature", "v").distinct().withColumn("n_ref", F.lit(0).cast("long"))
    known = numeric_counts(side.where("__ref"), list(features)).select("feature", "v", "n_ref")
    points, whole = cumulative(known.unionByName(values).groupBy("feature", "v").agg(F.sum("n_ref").alias("n_ref")), ["feature"], "v", ["n_ref"], ["all_ref"])
    points = points.select("feature", "v", "cum_n_ref", (F.col("cum_n_ref") - F.col("n_ref")).alias("below"))
    test = Window.partitionBy("feature", *CASE)  # at most ``size`` rows
    drawn = batch.withColumn("cum_n_prod", F.sum("n_prod").over(test.orderBy("v"))).withColumn("all_prod", F.sum("n_prod").over(test))
    both = drawn.join(points, ["feature", "v"]).join(F.broadcast(whole.where("all_ref > 0")), "feature")  # a row a feature
    at = F.abs(F.col("cum_n_ref") / F.col("all_ref") - F.col("cum_n_prod") / F.col("all_prod"))
    before = F.abs(F.col("below") / F.col("all_ref") - (F.col("cum_n_prod") - F.col("n_prod")) / F.col("all_prod"))
    out = both.groupBy("feature", *CASE).agg(F.max(F.greatest(at, before)).alias("statistic"), F.max("all_ref").alias("n"), F.max("all_prod").alias("m"))
    out = out.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n"), F.col("m")))
    return out.select("feature", *CASE, "statistic", "p_value", (F.col("p_value") < alpha).alias("drift_detected"))


def detection_rate(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """The share of trials that alert, for each group."""
    return results.groupBy(*by).agg(F.count("*").alias("n_trials"), F.avg(F.col("drift_detected").cast("int")).alias("detection_rate"))


def latency(results: DataFrame) -> DataFrame:
    """``feature, trial, share``: the smallest shifted share of a batch that alerts; null if none does."""
    return results.groupBy("feature", "trial").agg(F.min(F.when(F.col("drift_detected"), F.col("share"))).alias("share"))


def class_report(pairs: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """``label, precision, recall, f1, support`` for each class and their macro and weighted averages."""
    rows = pairs.select(truth.cast("string").alias("t"), predicted.cast("string").alias("p")).where("t IS NOT NULL AND p IS NOT NULL").groupBy("t", "p").count()
    sides = rows.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("real")), F.struct(F.col("p").alias("label"), F.lit(False).alias("real")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"), "count")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    per = sides.groupBy("s.label").agg(total(F.col("s.real") & F.col("hit")).alias("tp"), total(F.col("s.real")).alias("support"), total(~F.col("s.real")).alias("found"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, s, p = F.col("tp"), F.col("support"), F.col("found")
    per = per.select("label", ratio(tp, p).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, s + p).alias("f1"), "support")
    means = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = per.agg(*[(F.sum(F.col(c) * s) / F.sum(s)).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("all")).withColumnRenamed("all", "support")
    return per.unionByName(means.withColumn("label", F.lit("macro avg"))).unionByName(weighted.withColumn("label", F.lit("weighted avg")))
