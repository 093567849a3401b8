"""Queries of single operators: readers, the engine's tables, clean features, joins, views of logs and studies."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import densities, drift, folders, logs, profile, scoring, trials
from tidemark.plans.analysis import KINDS, _profile_sql, _trials_sql
from tidemark.plans.queries import _KS, _REPORT, _SCORED, CATEGORIES, NUMBERS, SPLIT, _scored, is_reference, query, rounded, table
from tidemark.scratch import filesystem, new_path
from tidemark.sources import readers
from tidemark.sources.tables import Store
from tidemark.streaming import streams

_E = """WITH e AS (SELECT event_id, event_type AS project, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, (props::JSON ->> '$.k')::BIGINT AS k, CASE WHEN event_id % 11 <> 0 THEN 'u' || (user_id % 40) END AS bucket FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gappy(table(spark, sf_dir, "events"))


def _gappy(events: DataFrame) -> DataFrame:
    """Events with gaps: a project, two numbers and a category."""
    k = F.from_json("props", "k long")["k"]
    bucket = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))
    return events.select("event_id", F.col("event_type").alias("project"), "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), k.alias("k"), bucket.alias("bucket"))


FEATURES = ["value", "k", "bucket"]
_CELLS = """c AS (SELECT event_id, project, 'value' AS feature, value AS num, NULL::VARCHAR AS cat FROM e WHERE value IS NOT NULL UNION ALL SELECT event_id, project, 'k', k::DOUBLE, NULL FROM e WHERE k IS NOT NULL
    UNION ALL SELECT event_id, project, 'bucket', NULL, bucket FROM e WHERE bucket IS NOT NULL)"""


@query(f"{_E}, {_CELLS} SELECT event_id, feature, num, cat FROM c")
def prj1_clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are there, numbers as doubles."""
    return logs.features_of(_events(spark, sf_dir), ["event_id"], FEATURES)


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events")
def prj2_scrub_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN as null."""
    return readers.scrubbed(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))


@query(f"{_E} SELECT event_id, value, k FROM e WHERE value IS NOT NULL AND k IS NOT NULL")
def prj3_numbers_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which no number is missing."""
    return logs.without_gaps(_events(spark, sf_dir).select("event_id", "project", *FEATURES), True)


@query(f"{_E} SELECT project, bucket FROM e WHERE bucket IS NOT NULL")
def prj4_categories_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which no category is missing."""
    return logs.without_gaps(_events(spark, sf_dir).select("event_id", "project", *FEATURES), False)


@query(_profile_sql("part") + ", o AS (SELECT name, CASE name WHEN 'p_size' THEN 'ignore' WHEN 'p_name' THEN 'categorical' ELSE decision END AS kind FROM f) SELECT * FROM o WHERE kind IN ('continuous', 'categorical')")
def prj7_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's choice of two columns against the profile of part."""
    choice = spark.createDataFrame([("p_size", "ignore"), ("p_name", "categorical")], "name string, role string")
    return profile.routes(profile.profile(table(spark, sf_dir, "part"), "p_partkey"), choice)


@query(_SCORED + " SELECT event_id FROM scored WHERE is_ood = 1 AND event_id % 7 <> 0")
def prj9_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged events that have the feature."""
    return logs.anomalies(_scored(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))), "value").select("event_id")


@query(_SCORED + " SELECT 'Log ' || row_number() OVER (ORDER BY ts, event_id) AS timeline, is_ood, round(score, 9) AS score, event_id, value FROM scored")
def prj10_audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in order of time, labelled with their place."""
    return rounded(logs.in_sequence(_scored(spark, sf_dir), ["ts", "event_id"]).select("timeline", "is_ood", "score", "event_id", "value"), "score")


@query(f"{_E}, {_CELLS} SELECT feature, count(*) AS n FROM c GROUP BY 1")
def prj11_usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with two values or more, without the one named class."""
    events = _events(spark, sf_dir).withColumns({"Class": F.col("bucket"), "thin": F.when(F.col("event_id") == 1, 1.0)})
    return logs.usable(logs.features_of(events, ["event_id"], [*FEATURES, "Class", "thin"]))


@query("SELECT CASE WHEN user_id % 4 % 2 = 0 THEN (user_id % 4 // 2)::VARCHAR ELSE (user_id % 4 / 2)::VARCHAR END AS value, count(*) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY 1")
def prj12_float_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole floating point numbers lose their fraction as categories; NaN is none."""
    half = F.when(F.col("event_id") % 13 != 0, (F.col("user_id") % 4) / 2).otherwise(F.lit(float("nan")))
    return drift.category_counts(table(spark, sf_dir, "events").select(half.alias("half")), ["half"]).select(F.col("v").alias("value"), F.col("n_ref").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id::DOUBLE END AS mixed FROM events")
def prj13_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of which more than four fifths are numbers."""
    text = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    return profile.coerced(table(spark, sf_dir, "events").select("event_id", text.alias("mixed")))[0]


@query(f"SELECT 'l_tax' AS feature, count(*) FILTER (l_shipdate < TIMESTAMP '{SPLIT}') AS n_ref, count(*) FILTER (l_shipdate >= TIMESTAMP '{SPLIT}') AS n_prod FROM lineitem")
def jn2_shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features known to both sides only: the reference has quantity and tax, production tax and discount."""
    items = table(spark, sf_dir, "lineitem")
    old = drift.numeric_counts(items.where(is_reference()), ["l_quantity", "l_tax"])
    new = drift.numeric_counts(items.where(~is_reference()), ["l_tax", "l_discount"], F.lit(False))
    both = old.unionByName(new).groupBy("feature", "v").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_prod").alias("n_prod"))
    return drift.ks(both).select("feature", "n_ref", "n_prod")


_FENCES = "q AS (SELECT project, feature, quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.75) AS q3 FROM c WHERE event_id % 3 <> 0 AND num IS NOT NULL GROUP BY 1, 2), a AS (SELECT DISTINCT project, feature, cat FROM c WHERE event_id % 3 <> 0 AND cat IS NOT NULL AND cat < 'u3')"


_SCORES = f"""{_E}, {_CELLS}, {_FENCES},
    d AS (SELECT event_id, c.feature, CASE WHEN num < q1 - 3 * (q3 - q1) THEN CASE WHEN q3 = q1 THEN 1.0 ELSE (q1 - 3 * (q3 - q1) - num) / (q3 - q1) END WHEN num > q3 + 3 * (q3 - q1) THEN CASE WHEN q3 = q1 THEN 1.0 ELSE (num - q3 - 3 * (q3 - q1)) / (q3 - q1) END ELSE 0.0 END AS d
          FROM c JOIN q USING (project, feature) WHERE num IS NOT NULL
          UNION ALL SELECT event_id, feature, (NOT EXISTS (SELECT 1 FROM a WHERE a.project = c.project AND a.cat = c.cat))::INTEGER FROM c WHERE cat IS NOT NULL AND project IN (SELECT project FROM a)),
    s AS (SELECT event_id, max(d) AS score, count(*) AS n FROM d WHERE d > 0 GROUP BY 1)"""


@query(f"{_SCORES} SELECT event_id, round(coalesce(score, 0), 6) AS score, (score IS NOT NULL)::INTEGER AS is_ood FROM e LEFT JOIN s USING (event_id)")
def st6_jn1_event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against the fences and allowed values of its own project, over three features."""
    events = _events(spark, sf_dir)
    fences = logs.project_fences(events.where("event_id % 3 <> 0"), "project", FEATURES).where("value IS NULL OR value < 'u3'")
    return logs.score_events(events, "project", FEATURES, fences).select("event_id", F.round("score", 6).alias("score"), "is_ood")


@query(f"{_SCORES} SELECT event_id, feature, round(d, 6) AS deviation FROM d WHERE d > 0")
def st6_deviation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each event's map of deviations, with allowed values looked up by a join where there are over ten."""
    events = _events(spark, sf_dir)
    fences = logs.project_fences(events.where("event_id % 3 <> 0"), "project", FEATURES).where("value IS NULL OR value < 'u3'")
    scored = logs.score_events(events, "project", FEATURES, fences, narrow=10)
    return scored.select("event_id", F.explode("deviations").alias("feature", "deviation")).withColumn("deviation", F.round("deviation", 6))


@query(f"{_SCORES} SELECT event_id // 5 AS visit, project, round(coalesce(score, 0), 6) AS score, (score IS NOT NULL)::INTEGER AS is_ood FROM e LEFT JOIN s USING (event_id)")
def st6_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose ids repeat, within a project and between projects: every row has its own score."""
    events = _events(spark, sf_dir)
    fences = logs.project_fences(events.where("event_id % 3 <> 0"), "project", FEATURES).where("value IS NULL OR value < 'u3'")
    visits = events.withColumn("visit", F.floor(F.col("event_id") / 5))
    return logs.score_events(visits, "project", FEATURES, fences).select("visit", "project", F.round("score", 6).alias("score"), "is_ood")


@query(f"{_E}, {_CELLS} SELECT event_id, feature, cat FROM c WHERE cat IS NOT NULL AND cat NOT IN (SELECT DISTINCT bucket FROM e WHERE user_id < 30 AND bucket IS NOT NULL)")
def jn4_unknown_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the first users don't have."""
    events = _events(spark, sf_dir)
    known = logs.features_of(events.where("user_id < 30"), ["event_id"], ["bucket"]).select("feature", "cat").distinct()
    return logs.unknown_values(logs.features_of(events, ["event_id"], ["bucket"]), known).select("event_id", "feature", "cat")


@query("SELECT min(event_type) AS project FROM events")
def jn5_without_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose project has no baseline: that of the first event type."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("project"))
    first = events.agg(F.min("project").alias("first"))  # one row
    return logs.without_baseline(events, events.distinct().crossJoin(F.broadcast(first)).where("project <> first"))


@query(
    _SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM scored), h AS (SELECT event_type AS project, avg(is_ood) AS ratio FROM r WHERE n <= 10 GROUP BY 1),
    p AS (SELECT DISTINCT event_type AS project FROM events UNION SELECT 'none yet')
    SELECT project, CASE WHEN coalesce(ratio, 0) > 0.3 THEN 'Degraded' ELSE 'Healthy' END AS system_status, coalesce(ratio, 0) > 0.3 AS is_burst_alert, round(coalesce(ratio, 0), 9) AS drift_ratio FROM p LEFT JOIN h USING (project)"""
)
def st20_project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every project, one without logs among them."""
    rows = _scored(spark, sf_dir).withColumnRenamed("event_type", "project")
    return rounded(logs.project_health(rows.select("project").unionByName(spark.createDataFrame([("none yet",)], "project string")), rows, ["ts", "event_id"]), "drift_ratio")


@query("WITH c AS (SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, value)::INTEGER AS place, value, n, round(n / sum(n) OVER (), 9) AS share, count(*) OVER () AS categories FROM c")
def agg17_frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types, the most frequent first."""
    return rounded(logs.frequency_table(table(spark, sf_dir, "events"), "event_type"), "share")


_BASE, _PROD = "WHERE o_orderdate < TIMESTAMP '1996-01-01'", "WHERE o_orderdate >= TIMESTAMP '1996-01-01'"
_TRIAL = _trials_sql("sensitivity")
_WHOLE = """(SELECT x >= 1.3581 FROM (SELECT max(abs(ca / na - cb / nb)) * sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS x FROM (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
    FROM (SELECT o_totalprice AS v, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS a, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS b FROM orders GROUP BY 1) WINDOW w AS (ORDER BY v))))"""


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of three cases: batches of the baseline, of production, and of the baseline shifted by 1.5 standard deviations."""
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")
    base = orders.where(old)
    self_test = base.withColumn("ref", F.lit(True)).unionByName(base.withColumn("ref", F.lit(False)))
    size = 25_000
    same = trials.run(self_test, "o_orderkey", ["o_totalprice"], F.col("ref"), [(size, 0.0, 1.0), (size, 1.5, 1.0)], 10)
    new = trials.run(orders, "o_orderkey", ["o_totalprice"], old, [(size, 0.0, 1.0)], 10)
    truth = drift.ks(drift.numeric_counts(orders, ["o_totalprice"], old)).select("feature", F.col("drift_detected").alias("truth"))
    found = same.select(F.when(F.col("severity") == 0, "baseline").otherwise("injected").alias("scenario"), "feature", (F.col("severity") > 0).alias("truth"), F.col("drift_detected").alias("detected"))
    made = new.select("feature", F.col("drift_detected").alias("detected")).join(F.broadcast(truth), "feature", "left")  # a row a feature
    return found.unionByName(made.select(F.lit("production").alias("scenario"), "feature", F.coalesce("truth", F.lit(False)).alias("truth"), "detected"))


@query(
    f"""WITH j AS (SELECT CASE WHEN severity = 0 THEN 'baseline' ELSE 'injected' END AS scenario, severity > 0 AS truth, hit FROM ({_TRIAL.replace(_PROD, _BASE)} SELECT severity, hit FROM res) WHERE severity IN (0, 1.5)
    UNION ALL SELECT 'production', {_WHOLE}, hit FROM ({_TRIAL} SELECT severity, hit FROM res) WHERE severity = 0),
    k AS (SELECT scenario, 'o_totalprice' AS feature, * EXCLUDE (scenario) FROM j)
    SELECT scenario, feature, count(*) AS n, count(*) FILTER (truth) AS n_true, count(*) FILTER (truth AND hit) AS n_found, CASE WHEN count(*) FILTER (truth) = 0 THEN 0.0 ELSE count(*) FILTER (truth AND hit) / count(*) FILTER (truth) END AS recall
    FROM k GROUP BY GROUPING SETS ((scenario, feature), (scenario))"""
)
def val3_agg21_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each case of the classification study and each feature of it."""
    return logs.recall_by(_study(spark, sf_dir), "scenario", "feature")


_JUDGED = ["l_quantity", "l_tax", "l_discount"]


@query(
    f"""WITH t AS (SELECT feature, p < 0.05 AS truth FROM (WITH {_KS} SELECT * FROM kp) WHERE feature <> 'l_discount'),
    d AS (SELECT feature, p < 0.05 AS detected FROM (WITH {_KS.replace("FROM lineitem", "FROM (SELECT * REPLACE (l_quantity + 2 * (l_shipdate >= TIMESTAMP '1996-01-01')::INTEGER AS l_quantity) FROM lineitem WHERE l_orderkey % 2 = 0)")} SELECT * FROM kp) WHERE feature <> 'l_tax')
    SELECT feature, coalesce(truth, false) AS truth, coalesce(detected, false) AS detected FROM t FULL JOIN d USING (feature) WHERE feature <> 'l_extendedprice'"""
)
def jn7_truth_and_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of all items as the truth, that of every second order, quantities moved, as detections; each side lacks a feature."""
    items = table(spark, sf_dir, "lineitem")
    found = lambda rows, names: drift.ks(drift.numeric_counts(rows, names, is_reference())).select("feature", "drift_detected")
    truth = found(items, [n for n in _JUDGED if n != "l_discount"]).withColumnRenamed("drift_detected", "truth")
    moved = items.where("l_orderkey % 2 = 0").withColumn("l_quantity", F.col("l_quantity") + F.when(is_reference(), 0).otherwise(2))
    return logs.judged(truth, found(moved, [n for n in _JUDGED if n != "l_tax"]).withColumnRenamed("drift_detected", "detected"))


@query(
    f"""WITH ref AS (SELECT o_totalprice AS v FROM orders {_BASE}), prod AS (SELECT o_totalprice AS v FROM orders {_PROD}) SELECT 'o_totalprice' AS feature, {_WHOLE} AS truth"""
)
def st22_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether order prices drifted between the whole tables."""
    old = F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")
    return drift.ks(drift.numeric_counts(table(spark, sf_dir, "orders"), ["o_totalprice"], old)).select("feature", F.col("drift_detected").alias("truth"))


@query(
    " UNION ALL ".join(
        f"""(WITH c AS (SELECT {c} AS v, (count(*) FILTER (l_shipdate < TIMESTAMP '{SPLIT}'))::DOUBLE AS a, (count(*) FILTER (l_shipdate >= TIMESTAMP '{SPLIT}'))::DOUBLE AS b FROM lineitem GROUP BY 1), w AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c),
    e AS (SELECT *, (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM w), h AS (SELECT sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb) / 2 AS h FROM e) SELECT '{c}' AS feature, round(exp(-h) * ({terms}), 6) AS p_value FROM h)"""
        for c, terms in (("l_returnflag", "1"), ("l_linenumber", "1 + h + h * h / 2"))
    )
)
def st21_chi_square_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the chi-square test of two categories."""
    counts = drift.category_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], is_reference())
    return densities.chi_square(counts).select("feature", F.round("p_value", 6).alias("p_value"))


@query(
    """WITH u AS (SELECT event_id, event_type, ts, value - 50 - 5 AS u, 50 - value - 5 AS d FROM events), c AS (SELECT *, sum(u) OVER w AS su, sum(d) OVER w AS sd FROM u WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    m AS (SELECT *, least(0, min(su) OVER w) AS mu, least(0, min(sd) OVER w) AS md FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
    SELECT event_id, round(su - mu, 4) AS high, round(sd - md, 4) AS low FROM m"""
)
def st23_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided CUSUM of event values by type."""
    out = logs.cusum(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], F.col("value"), F.lit(50.0), F.lit(5.0))
    return out.select("event_id", F.round("high", 4).alias("high"), F.round("low", 4).alias("low"))


@query("SELECT c_custkey, a.c_name, b.c_acctbal FROM customer a FULL JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) b USING (c_custkey)")
def set3_columns_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names beside positive balances."""
    customers = table(spark, sf_dir, "customer")
    return logs.beside(customers.select("c_custkey", "c_name"), customers.where("c_acctbal > 0").select("c_custkey", "c_acctbal"), "c_custkey")


@query("SELECT o_custkey, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT o_custkey, map_concat(map([o_orderpriority], [min(o_orderkey)]), map([max(o_orderpriority)], [max(o_orderkey)])) AS m FROM orders GROUP BY o_custkey, o_orderpriority)")
def set4_map_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of each customer and priority as one; the later order wins where keys are equal."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.create_map(F.col("o_orderpriority"), F.min("o_orderkey")).alias("old"), F.create_map(F.max("o_orderpriority"), F.max("o_orderkey")).alias("new"))
    return rows.select("o_custkey", F.explode(logs.merged_maps(F.col("old"), F.col("new"))).alias("k", "v"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def set4_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names win over old ones."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return logs.merged(nations, nations.where("n_regionkey = 1").withColumn("n_name", F.lower("n_name")), ["n_nationkey"]).drop("n_regionkey")


@query("SELECT c_custkey, c_acctbal, false AS drifted FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, round(c_acctbal + 1.5 * sd, 6), true FROM customer, (SELECT stddev_samp(c_acctbal) AS sd FROM customer WHERE c_custkey % 2 = 1) WHERE c_custkey % 2 = 1")
def set2_clean_and_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch half of which is shifted."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    moved = trials.shifted(customers.where("c_custkey % 2 = 1"), "c_acctbal", 1.5).withColumn("c_acctbal", F.round("c_acctbal", 6))
    return customers.where("c_custkey % 2 = 0").withColumn("drifted", F.lit(False)).unionByName(moved.withColumn("drifted", F.lit(True)))


_TRUE_KINDS = {"event_id": "ignore", "ts": "ignore", "user_id": "continuous", "event_type": "categorical", "value": "continuous", "props": "ignore"}


@query(_profile_sql("events") + f" SELECT count(*) AS n_columns, count(*) FILTER (decision = CASE name {' '.join(f'''WHEN '{n}' THEN '{k}' ''' for n, k in _TRUE_KINDS.items())} END) AS n_right FROM f")
def val6_profiler_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns of events are classified as labelled."""
    labels = spark.createDataFrame(list(_TRUE_KINDS.items()), "name string, label string")
    rows = profile.profile(table(spark, sf_dir, "events"), "event_id").join(F.broadcast(labels), "name")
    return rows.agg(F.count("*").alias("n_columns"), F.count_if(F.col("decision") == F.col("label")).alias("n_right"))


_FILES = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS file, name, kind, n_rows, n_unique, reason_code, decision FROM ({_profile_sql(t)} SELECT * FROM f)" for t in _FILES))
def val8_profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all tables that lie as delimited text somewhere below one folder, in one job."""
    root = new_path(spark, "tables")
    for t, key in _FILES.items():
        rows = table(spark, sf_dir, t).select(*KINDS[t])
        rows.repartitionByRange(key).sortWithinPartitions(key).write.options(header=True, sep=";" if t == "part" else ",", escape='"').csv(f"{root}/{'deep/' if t == 'part' else ''}{t}")
    out = folders.profile_files(spark, root, by_folder=True)
    return out.select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "name", "kind", "n_rows", "n_unique", "reason_code", "decision")


def _store(spark: SparkSession) -> Store:
    return Store(spark, new_path(spark, "store"))


@query("SELECT feature, kind, value, n FROM (SELECT 'l_returnflag' AS feature, 'categorical' AS kind, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 3 UNION ALL SELECT 'l_tax', 'continuous', round(l_tax * 100)::BIGINT::VARCHAR, count(*) FROM lineitem GROUP BY 3)")
def src13_snk1_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline locked twice and read back: the second replaces the first."""
    store, items = _store(spark), table(spark, sf_dir, "lineitem")
    store.lock_baseline("p", items, ["l_quantity"])
    store.lock_baseline("p", items, ["l_tax", "l_returnflag"], ["l_returnflag"])
    value = F.coalesce("value_cat", F.round(F.col("value_num") * 100).cast("long").cast("string"))
    return store.baseline("p").select("feature", "kind", value.alias("value"), "n")


@query("SELECT 'l_tax' AS feature, 'continuous' AS kind, round(quantile_cont(l_tax, 0.25), 9) AS q1, round(quantile_cont(l_tax, 0.75), 9) AS q3, NULL AS allowed FROM lineitem UNION ALL SELECT 'l_returnflag', 'categorical', NULL, NULL, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem")
def src14_st9_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences and allowed values of a locked baseline."""
    store = _store(spark)
    store.lock_baseline("p", table(spark, sf_dir, "lineitem"), ["l_tax"], ["l_returnflag"])
    return rounded(store.fences("p"), "q1", "q3").select("feature", "kind", "q1", "q3", F.array_join("allowed", ",").alias("allowed"))


@query("SELECT event_id, value, user_id FROM (SELECT event_id, value::VARCHAR AS value, user_id::VARCHAR AS user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def src16_newest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thousand logs of a project, decoded: the report's own limit."""
    store, events = _store(spark), table(spark, sf_dir, "events")
    last = events.agg(F.max("event_type")).first()[0]
    rows = events.where(F.col("event_type") == last).withColumns({"score": F.lit(0.0), "is_ood": F.lit(0)})
    store.append_logs(rows, ["value", "user_id"], "event_id", "ts", F.lit("p"))
    return scoring.flattened(store.logs("p", 1000), "input_data", ["value", "user_id"]).select("event_id", "value", "user_id")


@query("SELECT event_type AS project_id, count(*) AS n FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1")
def src15_snk3_snk4_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of every project after one of them is deleted by its encoded id."""
    store, events = _store(spark), table(spark, sf_dir, "events").withColumns({"score": F.lit(0.0), "is_ood": F.lit(0)})
    store.upsert_projects(events.select(F.col("event_type").alias("id"), F.col("event_type").alias("name"), F.lit("o").alias("owner")).distinct())
    store.append_logs(events, ["value"], "event_id", "ts", F.col("event_type"))
    first = events.agg(F.min("event_type").alias("id"))  # one row
    store.delete(first.select(store.link(F.col("id"))).first()[0])
    return store.table("logs").groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT n_name AS id FROM nation WHERE CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE n_regionkey END = 2")
def src17_snk2_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of an owner after some changed hands."""
    store, nations = _store(spark), table(spark, sf_dir, "nation")
    rows = nations.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("owner"))
    store.upsert_projects(rows)
    store.upsert_projects(rows.join(nations.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("id")), "id", "left_semi").withColumn("owner", F.lit("2")))
    return store.projects("2")


_TEXTS = """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name || CASE WHEN c_custkey % 3 = 0 THEN ', "so' || '" ' || chr(8364) ELSE '' END END AS c_name, c_acctbal FROM customer"""


def _texts(spark: SparkSession, sf_dir: str, euro: str = "€") -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit(', "so" ' + euro)).otherwise(F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, name).otherwise(F.lit("NA")).alias("c_name"), "c_acctbal")


def _back(spark: SparkSession, rows: DataFrame, reader, **options) -> DataFrame:
    path = new_path(spark, "delimited")
    rows.write.options(header=True, escape='"', **options).csv(path)
    return reader(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query(_TEXTS)
def src1_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through delimited text with quotes, null markers and a delimiter to be found."""
    return _back(spark, _texts(spark, sf_dir), readers.delimited, sep=";")


@query(_TEXTS)
def src2_western_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in cp1252, where the euro sign is the byte 80."""
    return _back(spark, _texts(spark, sf_dir, "\x80"), readers.delimited, encoding="ISO-8859-1")


_BROKEN = _TEXTS.replace("chr(8364)", "chr(8364) || chr(10) || '2nd' || chr(10) || '.'")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with quotes, a letter beyond ASCII, null markers and line breaks in their names."""
    return _texts(spark, sf_dir, "€\n2nd\n.")


@query(_BROKEN)
def src1_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through delimited text with line breaks in quoted cells, read by a task for each range of a file."""
    return _back(spark, _broken(spark, sf_dir), readers.delimited, sep="|")


@query(_BROKEN)
def src5_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through ZIP archives, every second in cp1252."""
    path = new_path(spark, "archives")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()  # a task that runs again writes the same archive
        system, folder = filesystem(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{number}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("data.csv", "w", force_zip64=True) as member, io.TextIOWrapper(member, "cp1252" if number % 2 else "utf-8", newline="") as text:
                writer = csv.writer(text, delimiter=";")
                for k, part in enumerate(parts):
                    writer.writerows(([part.schema.names] if not k else []) + list(zip(*[c.to_pylist() for c in part.columns], strict=True)))
        yield pa.RecordBatch.from_pylist([{"number": number}])

    _broken(spark, sf_dir).repartition(4, "c_custkey").mapInArrow(pack, "number long").write.format("noop").mode("overwrite").save()
    return readers.read(spark, f"{path}/*.zip").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT NULL, NULL, NULL FROM part WHERE p_partkey % 50 = 0")
def src6_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through JSON lines of which some are cut off: rows of nulls, no row is lost."""
    path = new_path(spark, "lines")
    whole = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    line = F.explode(F.when(F.col("p_partkey") % 50 == 0, F.array(F.substring(whole, 1, 9), whole)).otherwise(F.array(whole)))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return readers.json(spark, path).select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))


@query(_TEXTS)
def src3_src4_tsv_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through compressed text with tabs."""
    return _back(spark, _texts(spark, sf_dir), lambda s, p: readers.delimited(s, p, "\t"), sep="\t", compression="gzip")


@query("SELECT p_partkey, p_name, p_size FROM part")
def src6_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through JSON lines."""
    path = new_path(spark, "lines")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    return readers.json(spark, path).select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))


@query("SELECT c_custkey::DOUBLE AS id, round(c_acctbal, 2) AS balance, CASE WHEN c_custkey % 5 = 0 THEN '@home' ELSE c_mktsegment END AS place FROM customer")
def src8_arff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through ARFF, with rows that begin with an at sign."""
    path = new_path(spark, "arff")
    place = F.when(F.col("c_custkey") % 5 == 0, "@home").otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(",", place, F.col("c_custkey").cast("string"), F.round("c_acctbal", 2).cast("string")).alias("value"))
    head = "% note\n@RELATION r\n@ATTRIBUTE place string\n@ATTRIBUTE 'id' numeric\n@ATTRIBUTE balance numeric\n@DATA"
    rows.groupBy(F.pmod(F.xxhash64("value"), F.lit(16)).alias("part")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.sort_array(F.collect_list("value")), "\n")).alias("value")).write.partitionBy("part").text(path)
    return readers.arff(spark, path).select("id", "balance", "place")


@query("SELECT l_quantity AS Sensor_1, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS Sensor_3 FROM lineitem")
def src9_libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items through libsvm lines with missing and repeated indexes."""
    path = new_path(spark, "libsvm")
    even = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("3:9 3:"), F.col("l_tax").cast("string")))
    table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", F.lit("1"), F.concat(F.lit("1:"), F.col("l_quantity").cast("string")), even)).write.text(path)
    return readers.libsvm(spark, path)


@query("SELECT l_quantity AS c0, l_tax AS c1, CASE WHEN l_linenumber % 4 = 0 THEN l_discount END AS c2 FROM lineitem")
def src10_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items between white space, some lines wider than others."""
    path = new_path(spark, "spaced")
    more = F.when(F.col("l_linenumber") % 4 == 0, F.col("l_discount").cast("string"))
    table(spark, sf_dir, "lineitem").select(F.concat_ws("   ", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"), more)).write.text(path)
    return readers.spaced(spark, path)


@query(" UNION ALL ".join(f"SELECT '{k}' AS suffix, p_partkey, p_name, p_size FROM part" for k in ("jsonl", "parquet", "tsv", "txt.gz")))
def src11_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in four formats, each read by the reader of its suffix."""
    rows, path, out = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), new_path(spark, "part"), None
    rows.write.json(f"{path}.jsonl")
    rows.write.parquet(f"{path}.parquet")
    rows.write.options(header=True, sep="\t", escape='"').csv(f"{path}.tsv")
    rows.write.options(header=True, sep="|", escape='"', compression="gzip").csv(f"{path}.txt.gz")
    for suffix in ("jsonl", "parquet", "tsv", "txt.gz"):
        part = readers.read(spark, f"{path}.{suffix}").select(F.lit(suffix).alias("suffix"), F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH s AS (SELECT count(*) AS n, count(DISTINCT event_id) AS t, count(DISTINCT user_id % 80) AS w, count(DISTINCT value > 50) AS f, (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY value > 50)) AS dom FROM events)
    SELECT 'TIME' AS name, CASE WHEN t = n THEN 'time_index' ELSE 'numbers' END AS reason_code, CASE WHEN t = n THEN 'ignore' ELSE 'continuous' END AS decision, NULL AS best_guess FROM s
    UNION ALL SELECT 'who', CASE WHEN w <= 50 THEN 'few_texts' ELSE 'unclear' END, CASE WHEN w <= 50 THEN 'categorical' ELSE 'review' END, CASE WHEN w > 50 THEN 'ignore' END FROM s
    UNION ALL SELECT 'high', CASE WHEN dom > 0.99 THEN 'near_constant' ELSE 'unclear' END, CASE WHEN dom > 0.99 THEN 'ignore' ELSE 'review' END, CASE WHEN dom <= 0.99 THEN 'ignore' END FROM s"""
)
def st13_st14_time_and_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of times by its name, and guesses for columns that a person should look at."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("TIME"), F.concat(F.lit("u"), F.col("user_id") % 80).alias("who"), (F.col("value") > 50).alias("high"))
    return profile.profile(rows).select("name", "reason_code", "decision", "best_guess")


@query("SELECT r_regionkey AS k, r_name, NULL AS n_name FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def src12_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files as one table, columns by name."""
    rows = readers.read_all(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"])
    return rows.select(F.coalesce("r_regionkey", "n_nationkey").alias("k"), "r_name", "n_name")


assert set(_TRUE_KINDS) == set(KINDS["events"])


@query(f"{_SCORES} SELECT event_id, project, round(coalesce(score, 0), 6) AS score, (score IS NOT NULL)::INTEGER AS is_ood FROM e LEFT JOIN s USING (event_id)")
def str1_stored_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events scored against the fences and allowed values that a store has locked for each project."""
    store, events = _store(spark), table(spark, sf_dir, "events")
    known = F.when(F.col("bucket") < "u3", F.col("bucket")).alias("bucket")
    store.lock_baselines(_gappy(events).where("event_id % 3 <> 0").select("project", "value", "k", known), F.col("project"), ["value", "k"], ["bucket"])
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    scored = streams.score_by_project(_gappy(stream), "project", FEATURES, store)
    path = new_path(spark, "scored")
    streams.drained(scored.select("event_id", "project", F.round("score", 6).alias("score"), "is_ood"), new_path(spark, "state"), path)
    return spark.read.schema("event_id long, project string, score double, is_ood int").parquet(path)


_YEARS = (1996, 1997, 1998)


def _arrivals_sql(year: int) -> str:
    rows = f"(SELECT * REPLACE (l_quantity + CASE WHEN l_shipdate >= TIMESTAMP '{SPLIT}' THEN 3 * (year(l_shipdate) - 1996) ELSE 0 END AS l_quantity) FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}' OR year(l_shipdate) = {year})"
    return f"SELECT string_agg(feature, ',' ORDER BY feature) AS features FROM ({_REPORT.replace('FROM lineitem', f'FROM {rows}')} SELECT feature FROM report WHERE drift_detected)"


@query(f"SELECT features, count(*) AS n_alerts FROM ({' UNION ALL '.join(map(_arrivals_sql, _YEARS))}) WHERE features IS NOT NULL GROUP BY 1")
def str3_drift_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream that is stopped and goes on twice: a year of items a time, quantities moved more each year.

    The last micro-batch comes once more, as after a failure between its commit and Spark's log of it; it alerts once.
    """
    store, items = _store(spark), table(spark, sf_dir, "lineitem").select("l_shipdate", *NUMBERS, *CATEGORIES)
    store.lock_baseline("p", items.where(is_reference()), NUMBERS, CATEGORIES)
    moved = items.where(~is_reference()).withColumn("l_quantity", F.col("l_quantity") + 3 * (F.year("l_shipdate") - 1996))
    folder, state = new_path(spark, "arrivals"), new_path(spark, "state")
    for number, year in enumerate(_YEARS):
        moved.where(F.year("l_shipdate") == year).write.mode("append").parquet(folder)
        streams.drained(spark.readStream.schema(moved.schema).parquet(folder), state, streams.drift_batches(store, "p", "arrivals"))
    streams.drift_batches(store, "p", "arrivals")(moved.where(F.year("l_shipdate") == year), number)
    return store.table("alerts").groupBy("features").agg(F.count("*").alias("n_alerts"))


@query(f"SELECT n_name AS project_id, r_name AS owner FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 AND n_regionkey <> 1")
def snk5_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the owner that each project has when it drifts, after a change of hands; those of a deleted owner's projects go with them."""
    store, nations, regions = _store(spark), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("owner"), "n_nationkey", "n_regionkey")
    store.upsert_projects(rows.withColumn("owner", F.lit("nobody")).drop("n_nationkey", "n_regionkey"))
    store.upsert_projects(rows.drop("n_nationkey", "n_regionkey"))
    drifted = rows.select(F.col("id").alias("project_id"), (F.col("n_nationkey") % 2 == 0).alias("drift_detected"), F.lit("f").alias("feature"))
    store.alerts(drifted)
    store.delete_all(rows.where("n_regionkey = 1").select("id"))
    return store.table("alerts").select("project_id", "owner")


@query("SELECT id, message FROM (SELECT 'nation ' || n_name || '/' || n_nationkey AS id, ' nation ' || n_name || '/' || n_nationkey || ': f' AS message FROM nation) WHERE id <> 'nation ' || (SELECT min(n_name) FROM nation) || '/' || (SELECT min_by(n_nationkey, n_name) FROM nation)")
def snk4_encoded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with letters that addresses encode: one of them is deleted by its encoded form; the messages of the others, without the time."""
    store, nations = _store(spark), table(spark, sf_dir, "nation")
    name = F.concat(F.lit("nation "), "n_name", F.lit("/"), F.col("n_nationkey").cast("string"))
    rows = nations.select(name.alias("id"), F.col("n_name").alias("name"), F.lit("o").alias("owner"))
    store.upsert_projects(rows)
    store.alerts(rows.select(F.col("id").alias("project_id"), F.lit(True).alias("drift_detected"), F.lit("f").alias("feature")))
    store.delete(rows.agg(F.min("id").alias("id")).select(store.link(F.col("id"))).first()[0])
    told = store.messages("o")
    return told.select(F.col("project_id").alias("id"), F.regexp_replace("message", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "").alias("message"))
