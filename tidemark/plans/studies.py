"""Studies of drift detection over all features of lineitem, numbers and categories, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import logs, scoring, trials
from tidemark.plans.queries import _REPORT, CATEGORIES, NUMBERS, SPLIT, _report, is_reference, query, rounded, table

#: Rows of a batch, trials, and shifts in standard deviations: mild, moderate, severe. The re-check has seeds and a size of its own.
SIZE, TRIALS, SHIFTS, MODERATE = 25_000, 15, (0.5, 1.5, 3.0), 1.5
SENSITIVITY_TRIALS, FRESH_FIRST, FRESH_SIZE = 10, 20, 15_000


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with one key."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_shipdate", *NUMBERS, *CATEGORIES)


def _study_sql(first: int, n: int, size: int, batches: str) -> str:
    """``res(scenario, severity, trial, feature, hit)``: ``batches`` gives (scenario, severity, trial, feature, v) of numbers from ``long``."""
    numbers = " UNION ALL ".join(f"SELECT old, trial, '{c}' AS feature, {c}::DOUBLE AS v FROM b WHERE {c} IS NOT NULL" for c in NUMBERS)
    reference = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM items WHERE old AND {c} IS NOT NULL" for c in NUMBERS)
    words = " UNION ALL ".join(f"SELECT old, trial, '{c}' AS feature, {c}::VARCHAR AS v FROM b WHERE {c} IS NOT NULL" for c in CATEGORIES)
    known = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS v FROM items WHERE old AND {c} IS NOT NULL" for c in CATEGORIES)
    return f"""WITH items AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_shipdate < TIMESTAMP '{SPLIT}' AS old, {", ".join(NUMBERS + CATEGORIES)} FROM lineitem),
    b AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old, trial ORDER BY md5(k || '|' || trial), k) AS r FROM items, range({first}, {first + n}) x(trial)) WHERE r <= {size}),
    long AS MATERIALIZED ({numbers}), ref AS MATERIALIZED (SELECT feature, v, count(*) AS a FROM ({reference}) GROUP BY 1, 2), batches AS MATERIALIZED ({batches}),
    k1 AS (SELECT scenario, severity, trial, feature, v, sum(a) AS a, sum(b) AS b FROM (SELECT *, 0 AS a, 1 AS b FROM batches UNION ALL SELECT d.*, v, a, 0 FROM ref JOIN (SELECT DISTINCT scenario, severity, trial, feature FROM batches) d USING (feature)) GROUP BY ALL),
    k2 AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM k1 WINDOW w AS (PARTITION BY scenario, severity, trial, feature ORDER BY v), t AS (PARTITION BY scenario, severity, trial, feature)),
    k3 AS (SELECT scenario, severity, trial, feature, max(abs(ca / na - cb / nb)) * sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS x FROM k2 GROUP BY ALL),
    res AS (SELECT scenario, severity, trial, feature, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END < 0.05 AS hit FROM k3),
    cb AS (SELECT old, trial, feature, v, count(*) AS b FROM ({words}) GROUP BY ALL), cr AS (SELECT feature, v, count(*) AS a FROM ({known}) GROUP BY ALL),
    cs AS (SELECT old, trial, feature, v, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT * FROM cr, (SELECT DISTINCT old, trial FROM cb)) FULL JOIN cb USING (old, trial, feature, v)),
    cw AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb FROM cs WINDOW w AS (PARTITION BY old, trial, feature)), ce AS (SELECT *, CASE WHEN a = 0 THEN 0.0001 ELSE a / na END AS e, CASE WHEN b = 0 THEN 0.0001 ELSE b / nb END AS q FROM cw),
    cat AS (SELECT CASE WHEN old THEN 'baseline' ELSE 'production' END AS scenario, trial, feature, sum((q - e) * ln(q / e)) > 0.2 AS hit FROM ce GROUP BY ALL)"""


_MOVED = f"SELECT 'injected' AS scenario, s AS severity, trial, feature, v + s * stddev_samp(v) OVER (PARTITION BY trial, feature, s) AS v FROM long, (VALUES {', '.join(f'({s}::DOUBLE)' for s in SHIFTS)}) x(s) WHERE old"


@query(_study_sql(1, SENSITIVITY_TRIALS, SIZE, _MOVED) + " SELECT feature, severity, count(*) AS n_trials, round(avg(hit::INTEGER), 9) AS detection_rate FROM res GROUP BY 1, 2")
def val2_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rate of each number of items moved by half, one and a half and three standard deviations, in ten batches of the baseline."""
    base = _items(spark, sf_dir).where(is_reference())
    both = base.withColumn("ref", F.lit(True)).unionByName(base.withColumn("ref", F.lit(False)))
    found = trials.run(both, "k", NUMBERS, F.col("ref"), [(SIZE, s, 1.0) for s in SHIFTS], SENSITIVITY_TRIALS)
    return rounded(trials.detection_rate(found, ["feature", "severity"]), "detection_rate")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario, feature, truth, detected`` of fifteen batches of the baseline, of production, and of the baseline with each number moved.

    The truth of production is the report over all items; of numbers and categories in the first two, of numbers in the third.
    """
    items = _items(spark, sf_dir)
    base = items.where(is_reference())
    truth = _report(spark, sf_dir).select("feature", F.col("drift_detected").alias("truth"))
    old, late = (trials.draw(side.drop("l_shipdate"), "k", SIZE, TRIALS) for side in (base, items.where(~is_reference())))  # each serves numbers and categories
    numbers = lambda batches, cases: trials.run(base, "k", NUMBERS, F.lit(True), cases, TRIALS, batches=batches)
    categories = lambda batches: trials.run_categories(base, "k", CATEGORIES, F.lit(True), SIZE, TRIALS, batches=batches)
    same = numbers(old, [(SIZE, 0.0, 1.0), (SIZE, MODERATE, 1.0)])
    same = same.select(F.when(F.col("severity") == 0, "baseline").otherwise("injected").alias("scenario"), "feature", (F.col("severity") > 0).alias("truth"), F.col("drift_detected").alias("detected"))
    quiet = categories(old).select(F.lit("baseline").alias("scenario"), "feature", F.lit(False).alias("truth"), F.col("drift_detected").alias("detected"))
    new = numbers(late, [(SIZE, 0.0, 1.0)]).select("feature", "drift_detected")
    new = new.unionByName(categories(late).select("feature", "drift_detected"))
    new = new.join(F.broadcast(truth), "feature", "left")  # a row a feature
    return same.unionByName(quiet).unionByName(new.select(F.lit("production").alias("scenario"), "feature", F.coalesce("truth", F.lit(False)).alias("truth"), F.col("drift_detected").alias("detected")))


_CASES = f"SELECT CASE WHEN old THEN 'baseline' ELSE 'production' END AS scenario, 0.0::DOUBLE AS severity, trial, feature, v FROM long UNION ALL {_MOVED.replace(', '.join(f'({s}::DOUBLE)' for s in SHIFTS), f'({MODERATE}::DOUBLE)')}"
_JUDGED = f"""{_study_sql(1, TRIALS, SIZE, _CASES)}, truth AS (SELECT feature, drift_detected FROM ({_REPORT} SELECT * FROM report)), hits AS (SELECT scenario, feature, hit FROM res UNION ALL SELECT scenario, feature, hit FROM cat),
    j AS (SELECT scenario, feature, CASE scenario WHEN 'baseline' THEN false WHEN 'injected' THEN true ELSE coalesce(drift_detected, false) END AS truth, hit FROM hits LEFT JOIN truth USING (feature))"""


@query(
    f"""{_JUDGED} SELECT scenario, feature, count(*) AS n, count(*) FILTER (truth) AS n_true, count(*) FILTER (truth AND hit) AS n_found, CASE WHEN count(*) FILTER (truth) = 0 THEN 0.0 ELSE count(*) FILTER (truth AND hit) / count(*) FILTER (truth) END AS recall
    FROM j GROUP BY GROUPING SETS ((scenario, feature), (scenario))"""
)
def val3_whole_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each scenario of the classification study, and of each feature in it."""
    return logs.recall_by(judgements(spark, sf_dir), "scenario", "feature")


@query(
    f"""{_JUDGED}, c AS (SELECT count(*) FILTER (truth AND hit) AS tp, count(*) FILTER (NOT truth AND hit) AS fp, count(*) FILTER (truth AND NOT hit) AS fn, count(*) FILTER (NOT truth AND NOT hit) AS tn FROM j)
    SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM c"""
)
def val3_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of the whole study, with precision, recall, F1 and accuracy."""
    return rounded(scoring.confusion(judgements(spark, sf_dir), F.col("truth"), F.col("detected")), "precision", "recall", "f1", "accuracy")


@query(_study_sql(FRESH_FIRST, TRIALS, FRESH_SIZE, "SELECT 'production' AS scenario, 0.0::DOUBLE AS severity, trial, feature, v FROM long WHERE NOT old") + " SELECT feature, count(*) AS n_trials, round(avg(hit::INTEGER), 9) AS detection_rate FROM res GROUP BY 1")
def val7_fresh_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rate of production batches once more, with fifteen seeds that no other study uses."""
    found = trials.run(_items(spark, sf_dir), "k", NUMBERS, is_reference(), [(FRESH_SIZE, 0.0, 1.0)], TRIALS, first=FRESH_FIRST)
    return rounded(trials.detection_rate(found, ["feature"]), "detection_rate")
