"""Point anomalies: events against quartile fences and allowed categories; totals, bursts and detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH, RECENT, BURST = 3.0, 10, 0.3


def deviation(value: Column, q1: Column, q3: Column) -> Column:
    """How far a number lies outside ``q1 - 3 iqr .. q3 + 3 iqr``, in iqr units; 1 if the iqr is 0; 0 inside, for NaN and null."""
    iqr, v = q3 - q1, value.cast("double")
    low, high = q1 - F.lit(REACH) * iqr, q3 + F.lit(REACH) * iqr
    far = F.when(v < low, low - v).when(v > high, v - high)
    return F.when(F.isnan(v) | v.isNull() | far.isNull(), F.lit(0.0)).when(iqr == 0, F.lit(1.0)).otherwise(far / iqr)


def unknown(value: Column, allowed: Column) -> Column:
    """1 for a category outside the allowed set, else 0 (null too)."""
    return F.when(value.isNotNull() & ~F.array_contains(allowed, value.cast("string")), F.lit(1.0)).otherwise(F.lit(0.0))


def with_score(events: DataFrame, deviations: list[Column]) -> DataFrame:
    """``events`` with score, the largest deviation, and is_ood, 1 if any is above 0. No shuffle; streams too."""
    score = F.greatest(*deviations) if len(deviations) > 1 else deviations[0] if deviations else F.lit(0.0)
    return events.withColumn("score", score).withColumn("is_ood", (F.col("score") > 0).cast("int"))


def log_totals(logs: DataFrame, by: list[str]) -> DataFrame:
    """Rows, anomalies and the anomaly rate in percent of each group."""
    return logs.groupBy(*by).agg(F.count("*").alias("n_logs"), F.coalesce(F.sum("is_ood"), F.lit(0)).alias("n_anomalies"), (F.lit(100.0) * F.coalesce(F.avg("is_ood"), F.lit(0.0))).alias("rate"))


def health(logs: DataFrame, project: str, order: list[str], recent: int = RECENT, burst: float = BURST) -> DataFrame:
    """For each project the flagged share of its last ``recent`` logs, and whether it is above ``burst``."""
    last = Window.partitionBy(project).orderBy(*[F.desc(c) for c in order])
    rows = logs.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= recent)
    return rows.groupBy(project).agg(F.avg("is_ood").alias("drift_ratio")).withColumn("is_burst_alert", F.col("drift_ratio") > burst)


def confusion(pairs: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: true and false positives and negatives, precision, recall, F1 (0 where undefined) and accuracy."""
    t, p = truth.alias("t"), predicted.alias("p")
    c = pairs.select(t, p).agg(F.count_if(F.expr("t AND p")).alias("tp"), F.count_if(F.expr("NOT t AND p")).alias("fp"), F.count_if(F.expr("t AND NOT p")).alias("fn"), F.count_if(F.expr("NOT t AND NOT p")).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def flattened(logs: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """``logs`` with the given keys of a JSON object as text columns in place of it; null where they are missing."""
    parsed = F.from_json(json_col, "map<string,string>")
    return logs.select(*[c for c in logs.columns if c != json_col], *[parsed.getItem(k).alias(k) for k in keys])
