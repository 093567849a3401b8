"""Streams of events: scores, burst alerts with state, drift of each micro-batch and anomaly rates of time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import logs, scoring
from tidemark.sources.tables import Store


def score_stream(events: DataFrame, deviations: list[Column]) -> DataFrame:
    """The stream with score and is_ood: no state, so any output mode and sink will do."""
    return scoring.with_score(events, deviations)


def score_by_project(events: DataFrame, project: str, features: list[str], store: Store) -> DataFrame:
    """The stream scored against the stored fences and allowed values of each event's project; ``deviations`` is a map.

    A join of the stream with a static table of one row a project, without state. The fences are those of the version that
    the store has when the stream starts; a restart takes up later ones.
    """
    return logs.score_events(events, project, features, store.at(store.version()).all_fences())


def burst_stream(scored: DataFrame, project: str, time: str, event: str, recent: int = scoring.RECENT, burst: float = scoring.BURST) -> DataFrame:
    """A row for each project of a micro-batch: drift_ratio and is_burst_alert over its last ``recent`` events so far.

    State is the newest events by (time, id), so the order of arrival makes no difference; ``update`` mode.
    """
    kind = dict(scored.dtypes)[project]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            last = sorted([*last, *zip(frame["t"].tolist(), frame["e"].tolist(), frame["o"].tolist(), strict=True)])[-recent:]
        state.update(tuple(map(list, zip(*last, strict=True))))
        ratio = sum(o for _, _, o in last) / len(last)
        yield pd.DataFrame({project: [key[0]], "drift_ratio": [ratio], "is_burst_alert": [ratio > burst]})

    rows = scored.select(F.col(project), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(event).cast("long").alias("e"), F.col("is_ood").cast("long").alias("o"))
    return rows.groupBy(project).applyInPandasWithState(step, f"{project} {kind}, drift_ratio double, is_burst_alert boolean", "t array<long>, e array<long>, o array<long>", "update", GroupStateTimeout.NoTimeout)


def drift_batches(store: Store, project_id: str, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: compares each micro-batch with the project's baseline and writes an alert if it drifted, once.

    The alert and the number of the micro-batch are one commit under ``stream``, by default the id that Spark gives the
    query and keeps in its checkpoint. A batch that Spark repeats, after a failure between the commit and its own log, is
    found there and writes nothing; one that failed before the commit has left nothing to see.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = stream or df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        held = df.persist()  # the report reads the batch for each kind of feature
        try:
            store.alert(project_id, store.report(project_id, held), (name, number) if name else None)
        finally:
            held.unpersist()

    return batch


def anomaly_rates(scored: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``start, <by>, n_logs, n_anomalies, rate`` of tumbling windows; later events than the watermark are dropped."""
    timed = scored.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = timed.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n_logs"), F.sum("is_ood").alias("n_anomalies"), (F.lit(100.0) * F.avg("is_ood")).alias("rate"))
    return rows.select(F.col("w.start").alias("start"), *by, "n_logs", "n_anomalies", "rate")




def drained(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append") -> None:
    """Runs a stream until it has read all that is there: into a folder of Parquet, or into a function of (micro-batch, number).

    A later call with the same checkpoint goes on from there.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    run = writer.format("parquet").option("path", sink).start() if isinstance(sink, str) else writer.foreachBatch(sink).start()
    run.awaitTermination()
