"""The engine's own tables in Parquet: projects, baselines as value counts, fences, allowed values, logs and alerts.

All of them share one list of versions (:mod:`tidemark.sources.commits`): locking a baseline, changing projects, appending and
deleting are one commit each over every table, and readers see all of it or nothing. Rows are partitioned by project:
replacing or deleting a project drops its partitions and rewrites nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import drift, logs
from tidemark.scratch import saved
from tidemark.sources.commits import Commits

SCHEMAS = {
    "projects": "changed long, name string, owner string, id string",
    "baselines": "kind string, feature string, value_num double, value_cat string, n long, project_id string",
    "fences": "feature string, kind string, q1 double, q3 double, allowed array<string>, project_id string",
    "allowed": "feature string, value string, project_id string",
    "logs": "event_id long, event_time timestamp, input_data string, score double, is_ood int, project_id string",
    "alerts": "owner string, event_time timestamp, features string, project_id string",
}
#: Fixed value: how the time of an alert is written in its message.
ALERT_TIME = "yyyy-MM-dd HH:mm:ss"


class Store:
    """Tables below one folder. Methods take and return DataFrames; a table that isn't there yet is empty.

    With ``version`` the store reads that version and writes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.commits = spark, Commits(spark, root, SCHEMAS, version, ("projects",))

    def at(self, version: int) -> Store:
        """The store as it was in ``version``."""
        return Store(self.spark, self.commits.root, version)

    def version(self) -> int:
        return self.commits.version()

    def _change(self, written: dict[str, dict], drop: dict[str, Sequence[str]] | None = None, batch: tuple[str, int] | None = None) -> None:
        """One commit: new folders by table, and keys that earlier folders lose. ``batch``, a stream and its number, commits once."""
        if self.commits.pinned is not None:
            raise ValueError("a store of an older version can't be changed")

        def change(state: dict) -> dict | None:
            tables, batches = dict(state["tables"]), dict(state["batches"])
            if batch and batches.get(batch[0], -1) >= batch[1]:
                return None  # this micro-batch has been committed
            for name, keys in (drop or {}).items():
                tables[name] = [e | {"dropped": sorted({*e["dropped"], *keys})} for e in tables.get(name, [])]
            for name, entry in written.items():
                tables[name] = [*tables.get(name, []), entry | {"batch": list(batch) if batch else None}]
            if batch:
                batches[batch[0]] = batch[1]
            return {"tables": tables, "batches": batches}

        self.commits.commit(change)

    def table(self, name: str) -> DataFrame:
        if name == "projects":
            newest = F.max_by(F.struct("name", "owner"), "changed").alias("p")
            return self.commits.table(name).groupBy("id").agg(newest).select("id", "p.name", "p.owner")
        return self.commits.table(name)

    def lock_baseline(self, project_id: str, df: DataFrame, continuous: Sequence[str] = (), categorical: Sequence[str] = ()) -> None:
        """Counts, fences and allowed values of ``df`` replace the project's, in one commit. A column named in both lists is categorical."""
        self.lock_baselines(df, F.lit(project_id), continuous, categorical, [project_id])

    def lock_baselines(self, df: DataFrame, project: Column, continuous: Sequence[str] = (), categorical: Sequence[str] = (), projects: Sequence[str] | None = None) -> None:
        """The same for the rows of every project in ``project``: one job and one commit for all. Other projects keep theirs.

        A project of ``projects`` without values is left with an empty baseline. Rows without a project take no part.
        """
        kinds, none, text = dict(df.dtypes), F.lit(None).cast("double"), F.lit(None).cast("string")
        cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("num"), text.alias("cat")) for f in continuous if f not in categorical]
        for f in categorical:
            key = drift.category_key(F.col(f), kinds[f])
            key = F.when(~F.isnan(F.col(f)), key) if kinds[f] in ("float", "double") else key
            cells.append(F.struct(F.lit(f).alias("feature"), none.alias("num"), key.alias("cat")))
        rows = df.select(project.cast("string").alias("project_id"), F.explode(F.array(*cells)).alias("c")).select("project_id", "c.*") if cells else self.spark.createDataFrame([], "project_id string, feature string, num double, cat string")
        rows = rows.where("project_id IS NOT NULL AND (cat IS NOT NULL OR (num IS NOT NULL AND NOT isnan(num)))")
        counts = saved(rows.groupBy("project_id", "feature", "num", "cat").agg(F.count("*").alias("n")), "counts")
        number = F.col("num").isNotNull()
        baselines = counts.select(F.when(number, "continuous").otherwise("categorical").alias("kind"), "feature", F.col("num").alias("value_num"), F.col("cat").alias("value_cat"), "n", "project_id")
        keys = ["project_id", "feature"]
        fences = drift.fences(counts.where(number).select(*keys, F.col("num").alias("v"), F.col("n").alias("n_ref")), keys)
        fences = fences.select("feature", F.lit("continuous").alias("kind"), "q1", "q3", F.lit(None).cast("array<string>").alias("allowed"), "project_id")
        # A list of allowed values is kept for the reports of narrow features only; the values themselves are rows.
        words = counts.where(~number)
        few = words.groupBy(*keys).agg(F.count("*").alias("k"))
        narrow = words.join(few.where(F.col("k") <= logs.NARROW), keys).groupBy(*keys).agg(F.sort_array(F.collect_set("cat")).alias("allowed"))
        fences = fences.unionByName(few.join(narrow, keys, "left").select("feature", F.lit("categorical").alias("kind"), none.alias("q1"), none.alias("q3"), "allowed", "project_id"))
        new = {"baselines": baselines, "fences": fences, "allowed": words.select("feature", F.col("cat").alias("value"), "project_id")}
        gone = sorted({*(projects or ()), *(r[0] for r in counts.select("project_id").distinct().collect())})  # a row a project
        self._change({n: self.commits.write(n, r) for n, r in new.items() if not r.isEmpty()}, {n: gone for n in new})

    def baseline(self, project_id: str) -> DataFrame:
        return self.table("baselines").where(F.col("project_id") == project_id)

    def fences(self, project_id: str) -> DataFrame:
        return self.table("fences").where(F.col("project_id") == project_id)

    def all_fences(self) -> DataFrame:
        """``project, feature, kind, q1, q3, value`` of all projects, as :func:`tidemark.operators.logs.score_events` reads them."""
        numbers = self.table("fences").where("kind = 'continuous'").select(F.col("project_id").alias("project"), "feature", "kind", "q1", "q3", F.lit(None).cast("string").alias("value"))
        none = F.lit(None).cast("double")
        return numbers.unionByName(self.table("allowed").select(F.col("project_id").alias("project"), "feature", F.lit("categorical").alias("kind"), none.alias("q1"), none.alias("q3"), "value"))

    def report(self, project_id: str, df: DataFrame) -> DataFrame:
        """Drift of ``df`` against the project's baseline. Columns unknown to it and features missing in ``df`` have no row."""
        base = self.baseline(project_id)
        known = {r[0]: r[1] for r in self.fences(project_id).select("feature", "kind").collect() if r[0] in df.columns}  # a row a feature
        parts = []
        for kind, count, test, value in (("continuous", drift.numeric_counts, drift.ks, "value_num"), ("categorical", drift.category_counts, drift.psi, "value_cat")):
            names = [f for f, k in known.items() if k == kind]
            if names:
                ref = base.where(F.col("kind") == kind).where(F.col("feature").isin(names)).select("feature", F.col(value).alias("v"), F.col("n").alias("n_ref"), F.lit(0).cast("long").alias("n_prod"))
                both = ref.unionByName(count(df, names, F.lit(False)))
                parts.append(test(both.groupBy("feature", "v").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_prod").alias("n_prod"))))
        if not parts:
            return self.spark.createDataFrame([], "feature string, kind string, n_ref long, n_prod long, statistic double, p_value double, drift_detected boolean")
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]

    def upsert_projects(self, rows: DataFrame) -> None:
        """``rows(id, name, owner)`` replace those with the same id, without a rewrite of the others; the newest owner has the project."""
        last = self.commits.version() + 1
        new = rows.select(F.lit(last).cast("long").alias("changed"), "name", "owner", "id").dropDuplicates(["id"])
        self._change({"projects": self.commits.write("projects", new)})

    def projects(self, owner: str) -> DataFrame:
        return self.table("projects").where(F.col("owner") == owner).select("id")

    def append_logs(self, scored: DataFrame, features: Sequence[str], event_id: str, event_time: str, project: Column) -> None:
        """Scored events as log rows of the projects in ``project``, one job for all; the features become a JSON object without nulls."""
        rows = scored.select(F.col(event_id).cast("long").alias("event_id"), F.col(event_time).cast("timestamp").alias("event_time"), F.to_json(F.struct(*features)).alias("input_data"), "score", "is_ood", project.cast("string").alias("project_id"))
        self._change({"logs": self.commits.write("logs", rows)})

    def logs(self, project_id: str, newest: int | None = None) -> DataFrame:
        """A project's logs in order of time, or the ``newest`` of them, latest first."""
        rows = self.table("logs").where(F.col("project_id") == project_id)
        return rows.orderBy("event_time", "event_id") if newest is None else rows.orderBy(F.desc("event_time"), F.desc("event_id")).limit(newest)

    def alert(self, project_id: str, report: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """One alert row if any feature of the report drifted. With ``batch``, a stream and the number of its micro-batch, once."""
        self.alerts(report.withColumn("project_id", F.lit(project_id)), batch)

    def alerts(self, reports: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """An alert row for each project of ``reports(project_id, feature, drift_detected)`` in which a feature drifted; one commit."""
        if batch and self.commits.state()["batches"].get(batch[0], -1) >= batch[1]:
            return  # repeated after its commit: nothing to compute
        owners = self.table("projects").select(F.col("id").alias("project_id"), "owner")
        names = F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features")  # names of columns
        rows = reports.where("drift_detected").groupBy("project_id").agg(names).join(owners, "project_id", "left")
        rows = saved(rows.select("owner", F.current_timestamp().alias("event_time"), "features", "project_id"), "alerts")
        self._change({} if rows.isEmpty() else {"alerts": self.commits.write("alerts", rows)}, batch=batch)

    def messages(self, owner: str) -> DataFrame:
        """``project_id, message``: the alerts of an owner as text, with the time as it is shown."""
        when = F.date_format("event_time", ALERT_TIME)
        return self.table("alerts").where(F.col("owner") == owner).select("project_id", F.concat(when, F.lit(" "), F.col("project_id"), F.lit(": "), F.col("features")).alias("message"))

    def delete(self, encoded_id: str) -> None:
        """Removes a project given by its URL-encoded id from every table, in one commit."""
        self.delete_all(self.spark.range(1).select(F.url_decode(F.lit(encoded_id)).alias("id")))

    def delete_all(self, projects: DataFrame) -> None:
        """Removes the projects of ``projects(id)`` from every table, in one commit."""
        gone = sorted(r[0] for r in projects.select("id").distinct().collect() if r[0] is not None)  # a row a project
        self._change({}, {n: gone for n in SCHEMAS})

    def link(self, project_id: Column) -> Column:
        """A project's id as it stands in an address, for :meth:`delete`."""
        return F.url_encode(project_id)

    def compact(self, name: str) -> None:
        """One folder in place of all of a table's: appends leave many. Another writer's commit meanwhile is kept."""
        before = self.commits.state()["tables"].get(name, [])
        if not before:
            return
        rows = self.commits.table(name)
        if name == "projects":
            newest = Window.partitionBy("id").orderBy(F.desc("changed"))
            rows = rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1")
        entry, gone = self.commits.write(name, rows), {e["folder"] for e in before}
        old = {e["folder"]: set(e["dropped"]) for e in before}

        def change(state: dict) -> dict | None:
            now = state["tables"].get(name, [])
            if not gone <= {e["folder"] for e in now}:
                return None  # compacted by another
            late = {k for e in now if e["folder"] in gone for k in set(e["dropped"]) - old[e["folder"]]}
            return state | {"tables": state["tables"] | {name: [entry | {"dropped": sorted(late)}, *[e for e in now if e["folder"] not in gone]]}}

        self.commits.commit(change)
