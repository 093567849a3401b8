"""Arrow batches in bounded parts, for functions that turn texts into Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows turned into Python objects at a time.
ROWS = 256
#: Rows of texts that travel to a Python worker at a time, and Spark's setting for it.
SENT, SENT_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has the session send at most SENT rows to a Python worker at a time; a smaller setting stays.

    Whole texts are long: Spark's 10,000 of them at once, on both sides of the pipe, take more of an executor than the work itself.
    """
    if not 0 < int(spark.conf.get(SENT_CONF)) <= SENT:
        spark.conf.set(SENT_CONF, SENT)


def columns(parts: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns as lists, a few rows at a time; integers stay exact beside nulls."""
    for part in parts:
        for k in range(0, part.num_rows, ROWS):
            piece = part.slice(k, ROWS)
            yield tuple(piece.column(n).to_pylist() for n in names)


def batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """A record batch of row tuples."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])
