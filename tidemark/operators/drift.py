"""Drift between a reference and a production batch, from value counts in long form.

Every statistic of a feature depends only on how often each value occurs on either side, so one aggregation over all
features feeds the Kolmogorov-Smirnov test, the stability index, quartile fences and frequency tables. Counts are
combined before the shuffle; running sums spread a feature with very many values over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import EXACT_ROWS, exact_ks_p
from tidemark.operators.running import cumulative

ALPHA, PSI_LIMIT, EPSILON, TERMS = 0.05, 0.2, 0.0001, 100


def category_key(column: Column, kind: str) -> Column:
    """A category as text: whole floating point numbers without a fraction, everything else as it prints."""
    if kind in ("double", "float"):
        whole = (column == F.floor(column)) & (F.abs(column) < F.lit(9e15))
        return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def _long(df: DataFrame, features: list[str], value: str, side: Column | None) -> DataFrame:
    kinds = dict(df.dtypes)
    pick = [(F.col(f).cast("double") if value == "num" else category_key(F.col(f), kinds[f])).alias(f"f{k}") for k, f in enumerate(features)]
    pick = [F.when(~F.isnan(F.col(f)), c).alias(f"f{k}") if value == "cat" and kinds[f] in ("float", "double") else c for k, (f, c) in enumerate(zip(features, pick, strict=True))]
    wide = df.select((side if side is not None else F.lit(True)).alias("ref"), *pick)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"f{k}").alias("v")) for k, f in enumerate(features)]))
    rows = wide.select("ref", pairs.alias("p")).select("ref", "p.feature", "p.v").where("ref IS NOT NULL AND v IS NOT NULL")
    return rows.where(~F.isnan("v")) if value == "num" else rows


def numeric_counts(df: DataFrame, features: list[str], is_reference: Column | None = None) -> DataFrame:
    """``(feature, v, n_ref, n_prod)``: how often each number occurs on either side; null and NaN are left out."""
    rows = _long(df, features, "num", is_reference)
    return rows.groupBy("feature", "v").agg(F.count_if("ref").alias("n_ref"), F.count_if(~F.col("ref")).alias("n_prod"))


def category_counts(df: DataFrame, features: list[str], is_reference: Column | None = None) -> DataFrame:
    """``(feature, v, n_ref, n_prod)``: how often each category occurs on either side; null is left out."""
    rows = _long(df, features, "cat", is_reference)
    return rows.groupBy("feature", "v").agg(F.count_if("ref").alias("n_ref"), F.count_if(~F.col("ref")).alias("n_prod"))


def kolmogorov(x: Column) -> Column:
    """The upper tail of Kolmogorov's distribution; 1 for small arguments, where the series is no use."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sided p-value of a two-sample KS distance."""
    return kolmogorov(d * F.sqrt(n.cast("double") * m / (n + m)))


def ks(counts: DataFrame, alpha: float = ALPHA, exact: bool = False) -> DataFrame:
    """``feature, kind, n_ref, n_prod, statistic, p_value, drift_detected`` by the two-sample KS test.

    Drift means ``p_value < alpha``. A feature without values on one side has no row. With ``exact``, sides of at most
    EXACT_ROWS values get the exact p-value.
    """
    run, whole = cumulative(counts, ["feature"], "v", ["n_ref", "n_prod"], ["all_ref", "all_prod"])
    whole = F.broadcast(whole.where("all_ref > 0 AND all_prod > 0"))  # a row a feature
    gap = F.abs(F.col("cum_n_ref") / F.col("all_ref") - F.col("cum_n_prod") / F.col("all_prod"))
    out = run.join(whole, "feature").groupBy("feature").agg(F.max("all_ref").alias("n_ref"), F.max("all_prod").alias("n_prod"), F.max(gap).alias("statistic"))
    out = out.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_prod")))
    if exact:
        few = out.where(F.greatest("n_ref", "n_prod") <= EXACT_ROWS).withColumn("p_value", exact_ks_p("statistic", "n_ref", "n_prod"))
        out = out.where(F.greatest("n_ref", "n_prod") > EXACT_ROWS).unionByName(few)
    return out.select("feature", F.lit("continuous").alias("kind"), "n_ref", "n_prod", "statistic", "p_value", (F.col("p_value") < alpha).alias("drift_detected"))


def psi(counts: DataFrame, limit: float = PSI_LIMIT, epsilon: float = EPSILON, group: Sequence[str] = ("feature",)) -> DataFrame:
    """The same columns by the Population Stability Index; ``p_value`` is null. A share of zero counts as ``epsilon``."""
    keys = list(group)
    whole = counts.groupBy(*keys).agg(F.sum("n_ref").alias("all_ref"), F.sum("n_prod").alias("all_prod")).where("all_ref > 0 AND all_prod > 0")  # a row a feature
    share = lambda n, of: F.when(F.col(n) == 0, F.lit(epsilon)).otherwise(F.col(n) / F.col(of))
    e, a = share("n_ref", "all_ref"), share("n_prod", "all_prod")
    out = counts.join(F.broadcast(whole), keys).groupBy(*keys).agg(F.max("all_ref").alias("n_ref"), F.max("all_prod").alias("n_prod"), F.sum((a - e) * F.ln(a / e)).alias("statistic"))
    return out.select(*keys, F.lit("categorical").alias("kind"), "n_ref", "n_prod", "statistic", F.lit(None).cast("double").alias("p_value"), (F.col("statistic") > limit).alias("drift_detected"))


def drift_report(df: DataFrame, is_reference: Column, continuous: list[str] = (), categorical: list[str] = (), alpha: float = ALPHA, limit: float = PSI_LIMIT) -> DataFrame:
    """A row for each feature that occurs on both sides: KS for continuous ones, PSI for categorical ones."""
    parts = [ks(numeric_counts(df, list(continuous), is_reference), alpha)] if continuous else []
    parts += [psi(category_counts(df, list(categorical), is_reference), limit)] if categorical else []
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def system_alert(report: DataFrame) -> DataFrame:
    """One row: whether any feature drifted, how many did, and their names in order."""
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))), ",")
    return report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("alert"), F.count_if("drift_detected").alias("n_drifted"), names.alias("features"))


def fences(counts: DataFrame, group: Sequence[str] = ("feature",)) -> DataFrame:
    """``<group>, q1, q3``: quartiles of the reference side by linear interpolation between order statistics."""
    keys = list(group)
    run, whole = cumulative(counts.where("n_ref > 0").select(*keys, "v", "n_ref"), keys, "v", ["n_ref"], ["n"])
    if keys == ["feature"]:
        whole = F.broadcast(whole)  # a row a feature
    picks, outs = [], []
    for name, q in (("q1", 0.25), ("q3", 0.75)):
        place = (F.col("n") - 1) * F.lit(q)
        at = lambda p: F.min(F.when(F.col("cum_n_ref") > p, F.col("v")))
        picks += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
        outs.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name))
    return run.join(whole, keys).groupBy(*keys).agg(*picks).select(*keys, *outs)


def frequencies(counts: DataFrame) -> DataFrame:
    """``feature, value, n, share`` of the reference side."""
    whole = counts.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"))
    return counts.where("n_ref > 0").join(F.broadcast(whole), "feature").select("feature", F.col("v").alias("value"), F.col("n_ref").alias("n"), (F.col("n_ref") / F.col("all_ref")).alias("share"))


def allowed_sets(counts: DataFrame) -> DataFrame:
    """``feature, allowed``: the categories of the reference side, in order."""
    return counts.where("n_ref > 0").groupBy("feature").agg(F.sort_array(F.collect_set("v")).alias("allowed"))
