"""The library's queries by name, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NUMBERS, CATEGORIES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_linenumber"]
SPLIT = "1996-01-01"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of fractions depend on their order in the last digits."""
    return df.withColumns({n: F.round(n, 9) for n in names})


def is_reference() -> Column:
    return F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp")



def _long_sql(columns: list[str], kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS {kind}) AS v, l_shipdate < TIMESTAMP '{SPLIT}' AS ref FROM lineitem WHERE {c} IS NOT NULL" for c in columns)


_KS = f"""kc AS (SELECT feature, v, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM ({_long_sql(NUMBERS, "DOUBLE")}) GROUP BY 1, 2),
    kr AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM kc WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature)),
    kd AS (SELECT feature, max(na)::BIGINT AS n_ref, max(nb)::BIGINT AS n_prod, max(abs(ca / na - cb / nb)) AS d FROM kr GROUP BY 1),
    kx AS (SELECT *, d * sqrt(n_ref::DOUBLE * n_prod / (n_ref + n_prod)) AS x FROM kd),
    kp AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END AS p FROM kx)"""
_PSI = f"""pc AS (SELECT feature, v, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM ({_long_sql(CATEGORIES, "VARCHAR")}) GROUP BY 1, 2),
    pw AS (SELECT feature, sum(a) AS na, sum(b) AS nb FROM pc GROUP BY 1),
    ps AS (SELECT feature, na, nb, CASE WHEN a = 0 THEN 0.0001 ELSE a / na END AS e, CASE WHEN b = 0 THEN 0.0001 ELSE b / nb END AS q FROM pc JOIN pw USING (feature)),
    pp AS (SELECT feature, max(na)::BIGINT AS n_ref, max(nb)::BIGINT AS n_prod, sum((q - e) * ln(q / e)) AS d FROM ps GROUP BY 1)"""
_REPORT = f"""WITH {_KS}, {_PSI}, report AS (
    SELECT feature, 'continuous' AS kind, n_ref, n_prod, round(d, 9) AS statistic, round(p, 9) AS p_value, p < 0.05 AS drift_detected FROM kp
    UNION ALL SELECT feature, 'categorical', n_ref, n_prod, round(d, 9), NULL, d > 0.2 FROM pp)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(table(spark, sf_dir, "lineitem"), is_reference(), NUMBERS, CATEGORIES)


@query(_REPORT + " SELECT * FROM report")
def st7_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of lineitem's features: shipped before 1996 against the rest."""
    return rounded(_report(spark, sf_dir), "statistic", "p_value")


@query(_REPORT + " SELECT coalesce(bool_or(drift_detected), false) AS alert, count(*) FILTER (drift_detected) AS n_drifted, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drift_detected), '') AS features FROM report")
def agg14_system_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any feature of the report drifted, and which."""
    return drift.system_alert(_report(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25), 9) AS q1, round(quantile_cont({c}, 0.75), 9) AS q3 FROM lineitem" for c in NUMBERS))
def agg1_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of lineitem's numbers."""
    return rounded(drift.fences(drift.numeric_counts(table(spark, sf_dir, "lineitem"), NUMBERS)), "q1", "q3")


@query("SELECT 'event_type' AS feature, event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def agg3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the event types."""
    return rounded(drift.frequencies(drift.category_counts(table(spark, sf_dir, "events"), ["event_type"])), "share")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    fence = drift.fences(drift.numeric_counts(events, ["value"])).select("q1", "q3")  # one row
    return scoring.with_score(events.crossJoin(F.broadcast(fence)), [scoring.deviation(F.col("value"), F.col("q1"), F.col("q3"))])


_SCORED = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    s AS (SELECT *, CASE WHEN value < q1 - 3 * (q3 - q1) THEN (q1 - 3 * (q3 - q1) - value) / (q3 - q1) WHEN value > q3 + 3 * (q3 - q1) THEN (value - (q3 + 3 * (q3 - q1))) / (q3 - q1) ELSE 0.0 END AS score FROM events, q),
    scored AS (SELECT *, (score > 0)::INTEGER AS is_ood FROM s)"""


@query(_SCORED + " SELECT event_id, round(score, 9) AS score, is_ood FROM scored")
def st6_score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against the fences of all."""
    return rounded(_scored(spark, sf_dir).select("event_id", "score", "is_ood"), "score")


@query(_SCORED + " SELECT event_type, count(*) AS n_logs, sum(is_ood)::BIGINT AS n_anomalies, round(100.0 * avg(is_ood), 9) AS rate FROM scored GROUP BY 1")
def agg12_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, anomalies and their rate for each event type."""
    return rounded(scoring.log_totals(_scored(spark, sf_dir), ["event_type"]), "rate")


@query(_SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM scored) SELECT user_id, round(avg(is_ood), 9) AS drift_ratio, avg(is_ood) > 0.3 AS is_burst_alert FROM r WHERE n <= 10 GROUP BY 1")
def health_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burst alerts of every user's last ten events."""
    return rounded(scoring.health(_scored(spark, sf_dir), "user_id", ["ts", "event_id"]), "drift_ratio")


@query(
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels)
    SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 9) AS accuracy FROM c"""
)
def agg18_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well "not toxic" predicts good quality."""
    return rounded(scoring.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0), "precision", "recall", "f1", "accuracy")
