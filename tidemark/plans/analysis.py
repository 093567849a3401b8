"""Queries of profiles, log analytics and detection studies, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import densities, drift, profile, scoring, trials
from tidemark.plans.queries import CATEGORIES, _scored, is_reference, query, rounded, table

KINDS = {
    "events": {"event_id": "int", "ts": "datetime", "user_id": "int", "event_type": "text", "value": "float", "props": "text"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "float"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "float"},
}
ORDERS = {"events": "event_id", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}


def _column_sql(name: str, c: str, kind: str) -> str:
    length = f"length({c})" if kind == "text" else "NULL::BIGINT"
    code = f"coalesce(avg(regexp_matches({c}, '^[A-Z0-9]{{3,}}[._\\-/][A-Z0-9]{{2,}}', 'i')::INTEGER), 0)" if kind == "text" else "0.0"
    span = f"max({c})::DOUBLE - min({c})::DOUBLE" if kind in ("int", "float") else "0.0"
    return f"""SELECT '{c}' AS name, '{kind}' AS kind, count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) / count(*) AS ratio, (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c})) AS dom,
        coalesce(avg({length}), 0) AS len, coalesce(stddev_samp({length}), 0) AS sd, {code} AS code, {span} AS span,
        (SELECT (bool_and(v >= p) OR bool_and(v <= p)) FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY {ORDERS[name]}) AS p FROM {name} WHERE {c} IS NOT NULL)) AS mono FROM {name}"""


def _profile_sql(name: str) -> str:
    return f"""WITH s AS ({" UNION ALL ".join(_column_sql(name, c, k) for c, k in KINDS[name].items())}),
    r AS (SELECT *, CASE WHEN dom > 0.99 AND n_unique <= 5 THEN 'near_constant' WHEN kind = 'datetime' THEN 'datetime' WHEN mono AND ratio > 0.85 THEN 'monotonic' WHEN kind = 'text' AND n_unique <= 50 THEN 'few_texts'
      WHEN kind = 'int' AND n_unique <= 20 THEN 'few_integers' WHEN kind IN ('int', 'float') THEN 'numbers' WHEN code > 0.75 AND len > 6 AND sd < 4 THEN 'code' WHEN ratio > 0.95 THEN 'identifier'
      WHEN ratio > 0.5 AND NOT (code > 0.75 AND len > 6) THEN 'free_text' ELSE 'unclear' END AS reason_code FROM s),
    f AS (SELECT *, CASE WHEN reason_code IN ('few_texts', 'few_integers') THEN 'categorical' WHEN reason_code = 'numbers' THEN 'continuous' WHEN reason_code = 'unclear' THEN 'review' ELSE 'ignore' END AS decision FROM r)"""


_FULL = " SELECT name, kind, n_rows, n_unique, round(ratio, 4) AS cardinality_ratio, round(dom, 4) AS dominant_ratio, round(len, 6) AS mean_length, round(sd, 6) AS length_std, round(code, 6) AS code_share, round(span, 6) AS value_range, reason_code, decision FROM f"


def _profiled(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = profile.profile(table(spark, sf_dir, name), ORDERS[name])
    ratios = {c: F.round(c, 4) for c in ("cardinality_ratio", "dominant_ratio")} | {c: F.round(c, 6) for c in ("mean_length", "length_std", "code_share", "value_range")}
    return out.withColumns(ratios).select("name", "kind", "n_rows", "n_unique", *ratios, "reason_code", "decision")


@query(_profile_sql("events") + _FULL)
def st11_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of events."""
    return _profiled(spark, sf_dir, "events")


@query(_profile_sql("part") + _FULL)
def st11_profile_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of part."""
    return _profiled(spark, sf_dir, "part")


@query(_profile_sql("part") + " SELECT name, kind, n_rows, reason_code, decision FROM f")
def st11_sketched_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from sketches of distinct and frequent values, without a shuffle of the values."""
    return profile.profile(table(spark, sf_dir, "part"), "p_partkey", sketches=True).select("name", "kind", "n_rows", "reason_code", "decision")


@query(f"""WITH t AS (SELECT * FROM customer ORDER BY md5(c_custkey || '|42'), c_custkey LIMIT 1000), {_profile_sql("customer").replace("FROM customer", "FROM t")[5:]} SELECT name, n_rows, n_unique, reason_code, decision FROM f""")
def lim4_sampled_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of a sample of a thousand customers by a hash of their key: the option itself."""
    out = profile.profile(table(spark, sf_dir, "customer"), "c_custkey", sample_key="c_custkey", sample_rows=1000)
    return out.select("name", "n_rows", "n_unique", "reason_code", "decision")


@query(_profile_sql("customer") + _FULL)
def st10_classify_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of every column of customer."""
    return _profiled(spark, sf_dir, "customer")


@query(_profile_sql("part") + " SELECT decision AS kind, count(*) AS n FROM f WHERE decision IN ('continuous', 'categorical') GROUP BY 1")
def agg16_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns of part are watched, by kind."""
    return profile.routes(profile.profile(table(spark, sf_dir, "part"), "p_partkey")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'event_type' AS feature, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS allowed FROM events")
def agg2_allowed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types that occur, in order."""
    counts = drift.category_counts(table(spark, sf_dir, "events"), ["event_type"])
    return drift.allowed_sets(counts).select("feature", F.array_join("allowed", ",").alias("allowed"))


_ERF = "(1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z))"
_NORMAL = """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), m AS (SELECT (q1 + q3) / 2 AS mu, greatest((q3 - q1) / 1.34896, 0.1) AS sigma FROM b)"""


def _event_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    normals = densities.normal_of(drift.fences(drift.numeric_counts(events, ["value"])))
    return drift.numeric_counts(events, ["value"], F.lit(False)), normals


@query(_NORMAL + " SELECT 'value' AS feature, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM m")
def st15_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal approximation of event values from their quartiles."""
    return _event_counts(spark, sf_dir)[1].select("feature", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(
    _NORMAL
    + f""", c AS (SELECT value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), r AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total FROM c),
    z AS (SELECT *, (v - mu) / (sigma * sqrt(2)) AS z, 1 / (1 + 0.3275911 * abs((v - mu) / (sigma * sqrt(2)))) AS t FROM r, m), f AS (SELECT *, 0.5 * (1 + sign(z) * {_ERF}) AS cdf FROM z),
    d AS (SELECT max(total)::BIGINT AS n, max(greatest(cum / total - cdf, cdf - (cum - n) / total)) AS d FROM f), x AS (SELECT *, d * sqrt(n) AS x FROM d),
    p AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END AS p FROM x)
    SELECT 'value' AS feature, n, round(d, 9) AS statistic, round(p, 9) AS p_value, p < 0.05 AS drift_detected FROM p"""
)
def st16_ks_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sample KS test of event values against their normal approximation."""
    return rounded(densities.ks_normal(*_event_counts(spark, sf_dir)), "statistic", "p_value")


_GRID = _NORMAL + """, e AS (SELECT least(min(value), any_value(mu) - 4 * any_value(sigma)) AS a, greatest(max(value), any_value(mu) + 4 * any_value(sigma)) AS b FROM events, m),
    g AS (SELECT i, a + (b - a) * i / 199.0::DOUBLE AS x, mu, sigma FROM e, m, range(200) r(i))"""


@query(_GRID + " SELECT 'value' AS feature, i::INTEGER AS i, round(x, 6) AS x, round(exp(-0.5 * ((x - mu) / sigma) * ((x - mu) / sigma)) / (sigma * sqrt(2 * pi())), 9) AS density FROM g")
def st17_baseline_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of the normal approximation on 200 places."""
    out = densities.baseline_density(densities.grids(*_event_counts(spark, sf_dir)))
    return rounded(out, "density").withColumn("x", F.round("x", 6))


@query(
    _GRID
    + """, c AS (SELECT value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), h AS (SELECT count(value) AS total, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events)
    SELECT 'value' AS feature, i::INTEGER AS i, round(x, 6) AS x, round(sum(n * exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / (h * sqrt(2 * pi())) / total), 9) AS density FROM g, c, h GROUP BY i, x"""
)
def st18_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel density of event values on 200 places."""
    counts, normals = _event_counts(spark, sf_dir)
    return rounded(densities.kernel_density(counts, densities.grids(counts, normals)), "density").withColumn("x", F.round("x", 6))


@query(
    """WITH RECURSIVE c AS (SELECT s_acctbal AS v, count(*) FILTER (s_suppkey % 2 = 0) AS a, count(*) FILTER (s_suppkey % 2 = 1) AS b FROM supplier GROUP BY 1),
    r AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c),
    d AS (SELECT max(na)::BIGINT AS a, max(nb)::BIGINT AS b, greatest(a, b) AS n, least(a, b) AS m, max(abs(ca / na - cb / nb)) AS d, round(max(abs(ca / na - cb / nb)) * max(na) * max(nb))::BIGINT AS top FROM r),
    walk AS (SELECT 0::BIGINT AS i, [CASE WHEN j * n < top THEN 1.0::DOUBLE ELSE 0.0 END FOR j IN range(m + 1)] AS w FROM d
             UNION ALL SELECT i + 1, [CASE WHEN abs((i + 1) * m - j * n) < top THEN list_sum(w[greatest(0, CASE WHEN (i + 1) * m < top THEN 0 ELSE ((i + 1) * m - top) // n + 1 END) + 1:j + 1]) ELSE 0.0 END FOR j IN range(m + 1)] FROM walk, d WHERE i < n),
    p AS (SELECT a, b, d, 1 - w[m + 1] / list_product([(n + k)::DOUBLE / k FOR k IN range(1, m + 1)]) AS p FROM walk, d WHERE i = n)
    SELECT 's_acctbal' AS feature, a AS n_ref, b AS n_prod, round(d, 9) AS statistic, round(p, 7) AS p_value, p < 0.05 AS drift_detected FROM p"""
)
def st2_exact_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p-value of the KS test of balances, suppliers with even against those with odd keys."""
    counts = drift.numeric_counts(table(spark, sf_dir, "supplier"), ["s_acctbal"], F.col("s_suppkey") % 2 == 0)
    return drift.ks(counts, exact=True).drop("kind").withColumns({"statistic": F.round("statistic", 9), "p_value": F.round("p_value", 7)})


@query(
    " UNION ALL ".join(
        f"""(WITH c AS (SELECT {c} AS v, (count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01'))::DOUBLE AS a, (count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01'))::DOUBLE AS b FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1),
    w AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb, count(*) OVER () AS k FROM c), e AS (SELECT *, (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM w),
    o AS (SELECT *, abs(a - ea) - CASE WHEN k = 2 THEN least(0.5, abs(a - ea)) ELSE 0 END AS oa, abs(b - eb) - CASE WHEN k = 2 THEN least(0.5, abs(b - eb)) ELSE 0 END AS ob FROM e)
    SELECT '{c}' AS feature, round(sum(oa * oa / ea + ob * ob / eb), 6) AS statistic, max(k) - 1 AS dof FROM o)"""
        for c in CATEGORIES
    )
)
def st21_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square statistics of lineitem's categories: shipped before 1996 against the rest."""
    counts = drift.category_counts(table(spark, sf_dir, "lineitem"), CATEGORIES, is_reference())
    return densities.chi_square(counts).drop("p_value").withColumn("statistic", F.round("statistic", 6))


#: The reference's sizes and trials (all rows, where a table has fewer).
_SIZE = 25_000
_CASES = {"sensitivity": [(_SIZE, 0.0, 1.0), (_SIZE, 0.5, 1.0), (_SIZE, 1.5, 1.0), (_SIZE, 3.0, 1.0)], "sizes": [(n, 0.3, 1.0) for n in (1_000, 3_000, 5_000, 10_000, 20_000, 50_000)], "latency": [(100, 1.5, k / 10) for k in range(11)]}
TRIALS = {"sensitivity": 10, "sizes": 8, "latency": 5}


def _trials_sql(name: str) -> str:
    cases = _CASES[name]
    values = ", ".join(f"({n}, {s}::DOUBLE, {p}::DOUBLE)" for n, s, p in cases)
    return f"""WITH ref AS (SELECT o_totalprice AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), prod AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
    t AS (SELECT k, v, trial, row_number() OVER (PARTITION BY trial ORDER BY md5(k || '|' || trial), k) AS r FROM prod, range(1, {TRIALS[name] + 1}) x(trial)),
    c AS (SELECT t.*, s.* FROM t, (VALUES {values}) s(size, severity, share) WHERE r <= size), sd AS (SELECT trial, size, severity, share, stddev_samp(v) AS sd FROM c GROUP BY ALL),
    p AS (SELECT trial, size, severity, share, v + CASE WHEN r <= share * size THEN severity * sd ELSE 0 END AS v FROM c JOIN sd USING (trial, size, severity, share)),
    u AS (SELECT *, 0 AS a, 1 AS b FROM p UNION ALL SELECT trial, size, severity, share, v, 1, 0 FROM ref, (SELECT DISTINCT trial, size, severity, share FROM p)),
    k1 AS (SELECT trial, size, severity, share, v, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL),
    k2 AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM k1 WINDOW w AS (PARTITION BY trial, size, severity, share ORDER BY v), t AS (PARTITION BY trial, size, severity, share)),
    k3 AS (SELECT trial, size, severity, share, max(abs(ca / na - cb / nb)) AS d, max(abs(ca / na - cb / nb)) * sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS x FROM k2 GROUP BY ALL),
    res AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END < 0.05 AS hit FROM k3)"""


def _trials(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reference = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    return trials.run(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice"], reference, _CASES[name], TRIALS[name])


@query(_trials_sql("sensitivity") + " SELECT 'o_totalprice' AS feature, severity, count(*) AS n_trials, round(avg(hit::INTEGER), 9) AS detection_rate FROM res GROUP BY severity")
def val2_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rate of order prices shifted by 0 to 3 standard deviations."""
    return rounded(trials.detection_rate(_trials(spark, sf_dir, "sensitivity"), ["feature", "severity"]), "detection_rate")


@query(
    _trials_sql("sensitivity")
    + """, pairs AS (SELECT (severity > 0)::VARCHAR AS t, hit::VARCHAR AS p FROM res), l AS (SELECT t AS label FROM pairs UNION SELECT p FROM pairs),
    g AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS support, count(*) FILTER (p = label) AS found FROM l, pairs GROUP BY label),
    r AS (SELECT label, CASE WHEN found = 0 THEN 0 ELSE tp / found END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, 2 * tp / (support + found) AS f1, support FROM g),
    o AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
    SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM o"""
)
def agg20_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of drift detection over shifted and unshifted batches."""
    return rounded(trials.class_report(_trials(spark, sf_dir, "sensitivity"), F.col("severity") > 0, F.col("drift_detected")), "precision", "recall", "f1")


@query(_trials_sql("sizes") + " SELECT size, count(*) AS n_trials, round(avg(hit::INTEGER), 9) AS detection_rate FROM res GROUP BY size")
def val4_batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rate of a small shift by batch size."""
    return rounded(trials.detection_rate(_trials(spark, sf_dir, "sizes"), ["size"]), "detection_rate")


@query(_trials_sql("latency") + " SELECT 'o_totalprice' AS feature, trial::INTEGER AS trial, min(CASE WHEN hit THEN share END) AS share FROM res GROUP BY trial")
def val5_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest shifted share of a batch that alerts."""
    return trials.latency(_trials(spark, sf_dir, "latency"))


@query("SELECT c_custkey, round(c_acctbal + 1.5 * stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def val1_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances moved by 1.5 standard deviations."""
    return trials.shifted(table(spark, sf_dir, "customer"), "c_acctbal", 1.5).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 500")
def lim3_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 orders in hash order: the sampling operator itself."""
    return trials.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("SELECT event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def prj8_flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of events as columns."""
    return scoring.flattened(table(spark, sf_dir, "events"), "props", ["k"]).select("event_id", "event_type", F.col("k").cast("long").alias("k"))


@query(
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), s AS (SELECT e.*, (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))::INTEGER AS o FROM events e, q)
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n_logs, sum(o)::BIGINT AS n_anomalies, round(100.0 * avg(o), 9) AS rate FROM s GROUP BY 1, 2"""
)
def str4_hourly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly rate of every hour and event type; the stream of the same name is its twin."""
    hour = F.window("ts", "1 hour")["start"].alias("start")
    return rounded(_scored(spark, sf_dir).groupBy(hour, "event_type").agg(F.count("*").alias("n_logs"), F.sum("is_ood").alias("n_anomalies"), (F.lit(100.0) * F.avg("is_ood")).alias("rate")), "rate")
