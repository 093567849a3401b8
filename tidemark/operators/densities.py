"""A baseline as a normal distribution: its test, densities on a grid, and the chi-square statistic of category counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import chi_square_p
from tidemark.operators.drift import ALPHA, kolmogorov
from tidemark.operators.running import cumulative
from tidemark.scratch import saved

POINTS, LEAST_SIGMA, IQR_SIGMAS = 200, 0.1, 1.34896
#: Formula 7.1.26 of Abramowitz and Stegun for erf, error below 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / (sigma * F.lit(math.sqrt(2)))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(z))
    tail = F.lit(0.0)
    for a in reversed(ERF_A):
        tail = (tail + F.lit(a)) * t
    erf = F.signum(z) * (F.lit(1.0) - tail * F.exp(-z * z))
    return F.lit(0.5) * (F.lit(1.0) + erf)


def normal_of(fences: DataFrame) -> DataFrame:
    """``feature, mu, sigma`` of ``fences(feature, q1, q3)``."""
    return fences.select("feature", ((F.col("q1") + F.col("q3")) / 2).alias("mu"), F.greatest((F.col("q3") - F.col("q1")) / F.lit(IQR_SIGMAS), F.lit(LEAST_SIGMA)).alias("sigma"))


def ks_normal(counts: DataFrame, normals: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``feature, n, statistic, p_value, drift_detected``: production counts against each feature's normal distribution."""
    run, whole = cumulative(counts.where("n_prod > 0").select("feature", "v", "n_prod"), ["feature"], "v", ["n_prod"], ["n"])
    whole = F.broadcast(whole.join(normals, "feature"))  # a row a feature
    cdf = normal_cdf(F.col("v"), F.col("mu"), F.col("sigma"))
    gap = F.greatest(F.col("cum_n_prod") / F.col("n") - cdf, cdf - (F.col("cum_n_prod") - F.col("n_prod")) / F.col("n"))
    out = run.join(F.broadcast(whole), "feature").groupBy("feature").agg(F.max("n").alias("n"), F.max(gap).alias("statistic"))  # a row a feature
    return out.withColumn("p_value", kolmogorov(F.col("statistic") * F.sqrt("n"))).withColumn("drift_detected", F.col("p_value") < alpha)


def grids(counts: DataFrame, normals: DataFrame, points: int = POINTS) -> DataFrame:
    """``feature, i, x, mu, sigma``: ``points`` places from min(values, mu - 4 sigma) to max(values, mu + 4 sigma)."""
    ends = counts.where("n_prod > 0").groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high")).join(normals, "feature")
    low, high = F.least("low", F.col("mu") - 4 * F.col("sigma")), F.greatest("high", F.col("mu") + 4 * F.col("sigma"))
    cells = ends.select("feature", "mu", "sigma", low.alias("a"), high.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return cells.select("feature", "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / F.lit(points - 1.0)).alias("x"), "mu", "sigma")


def bell(z: Column, scale: Column) -> Column:
    return F.exp(F.lit(-0.5) * z * z) / (scale * F.lit(math.sqrt(2 * math.pi)))


def baseline_density(grid: DataFrame) -> DataFrame:
    """``feature, i, x, density`` of the normal distributions."""
    return grid.select("feature", "i", "x", bell((F.col("x") - F.col("mu")) / F.col("sigma"), F.col("sigma")).alias("density"))


#: Bins for each bandwidth, and bins of a feature at most; where the range has more bandwidths, bins are wider.
FINE, MOST_BINS, REACH = 256, 1 << 20, 9.0


def kernel_density(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """``feature, i, x, density``: Gaussian kernels with Scott's bandwidth; features without spread have no rows.

    Values are dealt to the four nearest of fine bins by cubic weights, which keeps the sum of a smooth kernel to about
    1e-10 of its height; equal bins are added up before the shuffle. One task a feature then adds the bins near each place of the grid: at
    most MOST_BINS rows, however many values there are.
    """
    rows = counts.where("n_prod > 0")
    n, total = F.sum("n_prod"), F.sum(F.col("v") * F.col("n_prod"))
    mean = rows.groupBy("feature").agg(n.alias("n"), (total / n).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    per = rows.join(F.broadcast(mean), "feature").groupBy("feature").agg(F.max("n").alias("n"), F.sum((F.col("v") - F.col("mean")) ** 2 * F.col("n_prod")).alias("ss"), F.max("low").alias("low"), F.max("high").alias("high"))  # a row a feature
    h = F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    per = per.where("n > 1 AND ss > 0").select("feature", "n", h.alias("h"), "low", F.greatest(h / FINE, (F.col("high") - F.col("low")) / MOST_BINS).alias("width"))
    place = (F.col("v") - F.col("low")) / F.col("width")
    dealt = rows.join(F.broadcast(per), "feature").select("feature", "n_prod", F.floor(place).alias("b"), (place - F.floor(place)).alias("t"))
    t = F.col("t")
    weights = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
    four = F.explode(F.array(*[F.struct((F.col("b") + k - 1).alias("b"), (w * F.col("n_prod")).alias("w")) for k, w in enumerate(weights)]))
    bins = saved(dealt.select("feature", four.alias("c")).groupBy("feature", "c.b").agg(F.sum("c.w").alias("w")), "bins")
    places = grid.join(F.broadcast(per), "feature").select("feature", "i", "x", "n", "h", "low", "width")

    def added(bins: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if places.empty:
            return pd.DataFrame({"feature": [], "i": [], "x": [], "density": []})
        bins = bins.sort_values("b")
        n, h, low, width = (float(places[c].iloc[0]) for c in ("n", "h", "low", "width"))
        at, w, out = low + bins["b"].to_numpy() * width, bins["w"].to_numpy(), []
        for x in places["x"]:
            i, j = np.searchsorted(at, [x - REACH * h, x + REACH * h])
            out.append(float((w[i:j] * np.exp(-0.5 * ((x - at[i:j]) / h) ** 2)).sum()) / (n * h * math.sqrt(2 * math.pi)))
        return places[["feature", "i", "x"]].assign(density=np.maximum(out, 0.0))

    return bins.groupBy("feature").cogroup(places.groupBy("feature")).applyInPandas(added, "feature string, i int, x double, density double")


def chi_square(counts: DataFrame) -> DataFrame:
    """``feature, statistic, dof, p_value``: the test of the 2 x k table of category counts, with Yates' correction when k is 2."""
    whole = counts.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_prod").alias("all_prod"), F.count("*").alias("k")).where("all_ref > 0 AND all_prod > 0")
    term = F.lit(0.0)
    for n, of in (("n_ref", "all_ref"), ("n_prod", "all_prod")):
        expected = (F.col("n_ref") + F.col("n_prod")) * F.col(of) / (F.col("all_ref") + F.col("all_prod"))
        off = F.abs(F.col(n) - expected)
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        term = term + off * off / expected
    out = counts.join(F.broadcast(whole), "feature").groupBy("feature").agg(F.sum(term).alias("statistic"), (F.max("k") - 1).alias("dof"))  # a row a feature
    return out.withColumn("p_value", chi_square_p("statistic", "dof"))
