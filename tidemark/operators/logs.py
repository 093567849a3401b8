"""Events and logs in long form: clean features, scores against the fences of a project, health of projects, views of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.names import all_columns, col, free
from tidemark.operators import drift, scoring
from tidemark.operators.drift import category_key
from tidemark.scratch import saved

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_number(dtype: str) -> bool:
    return dtype in NUMBERS or dtype.startswith("decimal")


def features_of(events: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``keys, feature, num, cat``: a row for each feature of an event that isn't null; numbers as doubles, all else as text."""
    kinds = dict(events.dtypes)
    none = {"num": F.lit(None).cast("double"), "cat": F.lit(None).cast("string")}
    cells = [F.struct(F.lit(f).alias("feature"), (col(f).cast("double") if is_number(kinds[f]) else none["num"]).alias("num"), (none["cat"] if is_number(kinds[f]) else col(f).cast("string")).alias("cat")) for f in features]
    return events.select(*map(col, keys), F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").where("num IS NOT NULL OR cat IS NOT NULL")


def without_gaps(df: DataFrame, numbers: bool) -> DataFrame:
    """The numeric columns (or the others) of ``df``, in rows where none of them is null or NaN."""
    names = [n for n, t in df.dtypes if is_number(t) == numbers]
    return df.select(*map(col, names)).dropna("any")


def project_fences(df: DataFrame, project: str, features: list[str]) -> DataFrame:
    """``project, feature, kind, q1, q3, value``: quartiles of each number, and a row for each value of the others.

    The kind follows from the column's type, as the values' own type does; a feature without values has no row. Order
    statistics come from running counts over ranges, so a feature of many values is spread over tasks.
    """
    cells = features_of(df, [project], features).withColumnRenamed(project, "project")
    cells = saved(cells.groupBy("project", "feature", "num", "cat").agg(F.count("*").alias("n_ref")), "cells")
    numbers = drift.fences(cells.where("num IS NOT NULL AND NOT isnan(num)").select("project", "feature", F.col("num").alias("v"), "n_ref"), ["project", "feature"])
    none = F.lit(None).cast("double")
    numbers = numbers.select("project", "feature", F.lit("continuous").alias("kind"), "q1", "q3", F.lit(None).cast("string").alias("value"))
    return numbers.unionByName(cells.where("cat IS NOT NULL").select("project", "feature", F.lit("categorical").alias("kind"), none.alias("q1"), none.alias("q3"), F.col("cat").alias("value")))


#: Allowed values of a feature that travel inside its project's row; wider features are looked up by a join.
NARROW = 200
#: Rows of packed fences (one a project) that are sent to every task; more are met by a shuffle.
MOST_PROJECTS = 20_000


def packed_fences(fences: DataFrame, narrow: int = NARROW) -> DataFrame:
    """A row a project: ``numbers``, quartiles by feature; ``narrow``, allowed values of features with at most ``narrow`` of them; ``wide``, the names of the others."""
    q = F.struct(F.col("q1").cast("double").alias("q1"), F.col("q3").cast("double").alias("q3"))
    few = fences.where("kind = 'categorical'").groupBy("project", "feature").agg(F.count_distinct("value").alias("n"))
    values = fences.where("kind = 'categorical'").join(few.where(F.col("n") <= narrow), ["project", "feature"])
    values = values.groupBy("project", "feature").agg(F.collect_set("value").alias("values"))  # at most ``narrow``
    none = F.lit(None)
    numbers = fences.where("kind = 'continuous'").groupBy("project", "feature").agg(F.min(q).alias("q"))
    rows = numbers.select("project", "feature", "q", none.cast("array<string>").alias("values"), F.lit(False).alias("w"))
    rows = rows.unionByName(values.select("project", "feature", none.cast("struct<q1:double,q3:double>").alias("q"), "values", F.lit(False).alias("w")))
    rows = rows.unionByName(few.where(F.col("n") > narrow).select("project", "feature", none.cast("struct<q1:double,q3:double>").alias("q"), none.cast("array<string>").alias("values"), F.lit(True).alias("w")))
    pick = lambda c: F.map_from_entries(F.array_agg(F.when(F.col(c).isNotNull(), F.struct("feature", c))))  # noqa: E731  null where there is none
    out = rows.groupBy("project").agg(pick("q").alias("numbers"), pick("values").alias("narrow"), F.collect_list(F.when(F.col("w"), F.col("feature"))).alias("wide"))
    return out.select("project", *[F.coalesce(n, F.expr(f"CAST(map() AS {t})")).alias(n) for n, t in (("numbers", "map<string,struct<q1:double,q3:double>>"), ("narrow", "map<string,array<string>>"))], "wide")


def score_events(events: DataFrame, project: str, features: list[str], fences: DataFrame, narrow: int = NARROW, most_projects: int = MOST_PROJECTS) -> DataFrame:
    """``events`` with ``score``, ``is_ood`` and ``deviations``, a map of the features that deviate and by how much.

    ``fences(project, feature, kind, q1, q3, value)`` has a row for each number and one for each allowed value of a
    categorical feature. They become one row a project, which meets the events once; deviations are computed in the row,
    so ids may repeat and no event is shuffled while there are at most ``most_projects`` of them. A feature that has more than ``narrow``
    allowed values in some project is looked up by a join on (project, value). Features without a fence, null
    projects and projects without fences deviate in nothing: score 0 and an empty map. Streams may be scored against a
    static table of fences; the number of projects and the wide features are read when the stream starts.
    """
    taken = [*events.columns, "score", "is_ood", "deviations"]
    pack = saved(packed_fences(fences, narrow), "fences")
    wide = sorted({r[0] for r in pack.select(F.explode("wide")).distinct().collect()} & set(features))  # a row a column
    side = pack.select(F.col("project").alias(p := free(taken, "__project")), F.struct("numbers", "narrow").alias(m := free(taken, "__fences")))
    small = pack.limit(most_projects + 1).count() <= most_projects
    rows = events.join(F.broadcast(side) if small else side, col(project) == F.col(p), "left")
    found = {}
    for f in wide:
        k = free([*taken, p, m, *found.values()], f"__wide{len(found)}")
        known = fences.where((F.col("kind") == "categorical") & (F.col("feature") == f) & F.col("value").isNotNull())
        known = known.select(F.col("project").alias(a := free([*rows.columns, k], "__p")), F.col("value").alias(b := free([*rows.columns, k], "__v")), F.lit(True).alias(k)).distinct()
        rows = rows.join(known, (col(project) == F.col(a)) & (col(f).cast("string") == F.col(b)), "left").drop(a, b)
        found[f] = k
    if wide:
        names = pack.select(F.col("project").alias(w := free([*rows.columns], "__w")), F.col("wide").alias(ws := free([*rows.columns], "__names")))
        rows = rows.join(F.broadcast(names) if small else names, col(project) == F.col(w), "left").drop(w)
    kinds, each = dict(events.dtypes), []
    for f in features:
        if is_number(kinds[f]):
            fence = F.col(m)["numbers"][f]
            d = scoring.deviation(col(f), fence["q1"], fence["q3"])
        else:
            d = scoring.unknown(col(f), F.col(m)["narrow"][f])
            if f in found:
                d = F.when(F.array_contains(ws, f), F.when(col(f).isNotNull() & F.col(found[f]).isNull(), 1.0).otherwise(0.0)).otherwise(d)
        each.append(F.coalesce(d, F.lit(0.0)))
    entries = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*each)) if features else F.expr("CAST(map() AS map<string,double>)")
    far = F.map_filter(entries, lambda _, d: d > 0)
    rows = rows.select(*[col(n) for n in events.columns if n.lower() not in ("score", "is_ood", "deviations")], far.alias("deviations"))
    score = F.coalesce(F.array_max(F.map_values("deviations")), F.lit(0.0))
    return rows.select(*[col(n) for n in rows.columns if n != "deviations"], score.alias("score"), (score > 0).cast("int").alias("is_ood"), "deviations")


def unknown_values(cells: DataFrame, allowed: DataFrame) -> DataFrame:
    """The ``cells(feature, cat, ..)`` whose value isn't among ``allowed(feature, cat)``, for features that are known there."""
    return cells.join(allowed.select("feature").distinct(), "feature", "left_semi").join(allowed.select("feature", "cat"), ["feature", "cat"], "left_anti")


def project_health(projects: DataFrame, logs: DataFrame, order: list[str], recent: int = scoring.RECENT, burst: float = scoring.BURST) -> DataFrame:
    """``project, system_status, is_burst_alert, drift_ratio`` for every project, also without logs: those are Healthy with ratio 0."""
    seen = scoring.health(logs, "project", order, recent, burst)
    out = projects.select("project").distinct().join(seen, "project", "left").na.fill({"drift_ratio": 0.0, "is_burst_alert": False})
    return out.select("project", F.when(F.col("is_burst_alert"), "Degraded").otherwise("Healthy").alias("system_status"), "is_burst_alert", "drift_ratio")


def without_baseline(requests: DataFrame, baselines: DataFrame) -> DataFrame:
    """The projects of ``requests`` that have no baseline: each is an error of its request."""
    return requests.select("project").distinct().join(baselines.select("project"), "project", "left_anti")


def in_sequence(logs: DataFrame, order: list[str], label: str = "Log ") -> DataFrame:
    """``logs`` with ``timeline``, a label with the place of the row in time; places come from ranges, not from one task."""
    rows = saved(logs.repartitionByRange(*order).withColumn("__at", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = rows.groupBy("__at").count().select("__at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__at").orderBy(*order))
    out = rows.withColumn("__n", inside).join(F.broadcast(offsets), "__at")
    return out.select(*all_columns(logs), F.concat(F.lit(label), (F.col("__n") + F.col("__o")).cast("string")).alias("timeline"))


def anomalies(logs: DataFrame, feature: str) -> DataFrame:
    """Flagged rows in which the feature is there."""
    return logs.where((F.col("is_ood") == 1) & col(feature).isNotNull())


def usable(cells: DataFrame, least: int = 2) -> DataFrame:
    """``feature, n`` of the features worth a view: not the one named class, and with at least ``least`` values."""
    return cells.where(F.lower("feature") != "class").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """``place, value, n, share, categories``: the most frequent first, ties by value; places come from ranges, not from one task."""
    counts = df.select(category_key(col(column), dict(df.dtypes)[column]).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    counts = saved(counts, "counts")
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("categories"))  # one row
    placed = in_sequence(counts.withColumn("rare", -F.col("n")), ["rare", "value"], "")
    return placed.crossJoin(F.broadcast(whole)).select(F.col("timeline").cast("int").alias("place"), "value", "n", (F.col("n") / F.col("total")).alias("share"), "categories")


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of two tables side by side, matched by a row key; null where one has no such row."""
    return left.join(right, key, "full_outer")


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` and those of ``old`` whose key isn't in ``new``."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def merged_maps(old: Column, new: Column) -> Column:
    """One map of two, in which the values of ``new`` win; null counts as an empty map."""
    a, b = (F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for m in (old, new))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def judged(truth: DataFrame, detections: DataFrame, key: str = "feature") -> DataFrame:
    """``key, truth, detected`` for every detection and every truth; what one of them lacks counts as stable, not detected."""
    out = truth.select(key, "truth").join(detections.select(key, "detected"), key, "full_outer")
    return out.na.fill({"truth": False, "detected": False})


def recall_by(judgements: DataFrame, case: str, feature: str) -> DataFrame:
    """``case, feature, n, n_true, n_found, recall``: each case as a whole (feature null) and each feature of it, in one pass."""
    names = [case, feature]
    sets = judgements.groupingSets([names, [case]], *names)
    out = sets.agg(F.count("*").alias("n"), F.count_if("truth").alias("n_true"), F.count_if(F.col("truth") & F.col("detected")).alias("n_found"))
    return out.withColumn("recall", F.when(F.col("n_true") > 0, F.col("n_found") / F.col("n_true")).otherwise(0.0))


def cusum(df: DataFrame, group: str, order: list[str], value: Column, target: Column, slack: Column) -> DataFrame:
    """``df`` with ``high`` and ``low``, the two one-sided cumulative sums of Page (1954) in the order of each group.

    high is max(0, high before + value - target - slack) and low the same downwards. In closed form high is the running
    sum less the least of 0 and all running sums so far, so ranges of rows carry on from the totals and minima before.
    """
    rows = df.withColumns({"__u": value - target - slack, "__d": target - value - slack})
    rows = saved(rows.repartitionByRange(group, *order).withColumn("__at", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy(group, "__at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__s{c}": F.sum(f"__{c}").over(inside) for c in "ud"})
    rows = rows.withColumns({f"__m{c}": F.min(f"__s{c}").over(inside) for c in "ud"})
    ends = rows.groupBy(group, "__at").agg(*[F.sum(f"__{c}").alias(f"__t{c}") for c in "ud"], *[F.min(f"__s{c}").alias(f"__e{c}") for c in "ud"])
    before = Window.partitionBy(group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = ends.withColumns({f"__o{c}": F.coalesce(F.sum(f"__t{c}").over(before), F.lit(0.0)) for c in "ud"})
    ends = ends.withColumns({f"__p{c}": F.coalesce(F.min(F.col(f"__o{c}") + F.col(f"__e{c}")).over(before), F.lit(0.0)) for c in "ud"})
    out = rows.join(ends.select(group, "__at", *[f"__{k}{c}" for k in "op" for c in "ud"]), [group, "__at"])
    total = {c: F.col(f"__o{c}") + F.col(f"__s{c}") for c in "ud"}
    least = {c: F.least(F.lit(0.0), F.col(f"__p{c}"), F.col(f"__o{c}") + F.col(f"__m{c}")) for c in "ud"}
    return out.select(*all_columns(df), (total["u"] - least["u"]).alias("high"), (total["d"] - least["d"]).alias("low"))
