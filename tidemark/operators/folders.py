"""Profiles of every delimited file below a folder, in one job for all of them.

The files are read as lines, so a large file is read by many tasks and small ones share a task. A task counts the values of
each (file, column) and sums up each (range of lines, column) for the monotonic test; both are merged by Spark.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import profile
from tidemark.scratch import saved
from tidemark.sources.readers import NULLS, sniff, unique_names

#: Different values that a task counts before it hands them on, and headers that are sent to every task.
HELD, MOST_FILES = 100_000, 20_000
_PARTS = "file string, name string, v string, n long, block long, ends array<struct<up:boolean,down:boolean,first:struct<number:double,text:string>,last:struct<number:double,text:string>>>"


class _Ends:
    """Of the values of one column in a range: whether they never fell or rose, the first and the last; as text and as numbers."""

    def __init__(self) -> None:
        self.ends: list[list] = [[True, True, None, None], [True, True, None, None]]

    def add(self, text: str) -> None:
        try:
            number: float | None = float(text)
        except ValueError:
            number = None
        for end, value in zip(self.ends, (text, number), strict=True):
            if value is None:
                continue
            if end[3] is None:
                end[2] = value
            else:
                end[0] &= value >= end[3]
                end[1] &= value <= end[3]
            end[3] = value

    def row(self) -> list[dict]:
        (tu, td, tf, tl), (nu, nd, nf, nl) = self.ends
        as_text = {"up": tu, "down": td, "first": {"number": None, "text": tf}, "last": {"number": None, "text": tl}}
        return [as_text, {"up": nu, "down": nd, "first": {"number": nf, "text": None}, "last": {"number": nl, "text": None}}]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of values and ends of ranges, from lines that come in the order of their file; the first line of a file is its header."""
    end = pa.struct([("number", pa.float64()), ("text", pa.string())])
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("v", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.struct([("up", pa.bool_()), ("down", pa.bool_()), ("first", end), ("last", end)])))])
    counts: Counter = Counter()
    ends: dict[tuple[str, int, str], _Ends] = {}

    def counted() -> pa.RecordBatch:
        rows = [{"file": f, "name": c, "v": v, "n": n, "block": None, "ends": None} for (f, c, v), n in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    def ended() -> pa.RecordBatch:
        rows = [{"file": f, "name": c, "v": None, "n": None, "block": b, "ends": e.row()} for (f, b, c), e in ends.items()]
        ends.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if now != (now := (row["file"], row["block"])):
                if ends:
                    yield ended()
                if not row["block"]:
                    continue  # the header
            cells = next(csv.reader([row["value"]], delimiter=row["sep"]), [])
            for k, name in enumerate(row["names"]):
                text = cells[k].strip() if k < len(cells) else ""
                known = text not in NULLS
                counts[row["file"], name, text if known else None] += 1
                if known:
                    ends.setdefault((row["file"], row["block"], name), _Ends()).add(text)
        if len(counts) >= HELD:
            yield counted()
    yield counted()
    yield ended()


def profile_files(spark: SparkSession, folder: str, pattern: str = "*.csv", by_folder: bool = False) -> DataFrame:
    """``file`` and the columns of :func:`tidemark.operators.profile.profile`, for every file below ``folder`` whose name fits.

    The first line of a file holds the names and decides its delimiter; its own lines are the order of the monotonic test.
    With ``by_folder`` the files of one folder are one table (``file`` is the folder), in the order of their names. A column is numeric
    if more than ``PARSED`` of its values are numbers, whole if all are, else text. Cells must not hold line breaks;
    short rows are filled with nulls. Without a file there are no rows; a file with a header only has empty columns.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    first = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("line", "value")).alias("h")).select("file", F.col("h.value").alias("header"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sep = sniff([row["header"]])
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "header": row["header"], "sep": sep, "names": unique_names(next(csv.reader([row["header"]], delimiter=sep), []))}])

    heads = saved(first.mapInArrow(named, "file string, header string, sep string, names array<string>"), "headers")  # a row a file
    if heads.limit(MOST_FILES + 1).count() <= MOST_FILES:
        rows = lines.join(F.broadcast(heads), "file")
    else:
        rows = lines.join(heads, "file").repartition("file", "block").sortWithinPartitions("file", "block", "line")
    rows = rows.where("trim(value) <> ''").select("file", "block", "value", "sep", "names")
    unit = F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.col("file")
    parts = saved(rows.mapInArrow(_parts, _PARTS).withColumn("unit", unit), "cells")
    known = heads.select(unit.alias("unit"), F.explode("names").alias("name")).distinct()
    keys = ["unit", "name"]
    counts = saved(parts.where("n IS NOT NULL").groupBy(*keys, "v").agg(F.sum("n").alias("n")), "counts")
    there = F.when(F.col("v").isNotNull(), F.col("n"))
    share = lambda pattern: F.coalesce(F.sum(F.when(F.col("v").rlike(pattern), F.col("n"))), F.lit(0)) / F.sum(there)
    kinds = counts.groupBy(*keys).agg(share(profile.NUMBER).alias("number"), share(profile.WHOLE).alias("whole"))
    kind = F.when(F.coalesce("number", F.lit(0.0)) <= profile.PARSED, "text").when(F.col("whole") == 1.0, "int").otherwise("float").alias("kind")
    kinds = saved(kinds.select(*keys, kind), "kinds")  # a row a column
    number = F.when(F.col("v").rlike(profile.NUMBER), F.trim("v").try_cast("double"))
    value = F.when(F.col("kind") == "text", F.col("v")).otherwise(profile.category_key(number, "double"))
    typed = counts.join(kinds, keys).select(*keys, "kind", value.alias("v"), "n").groupBy(*keys, "kind", "v").agg(F.sum("n").alias("n"))
    rows = known.join(kinds, keys, "left").withColumn("kind", F.coalesce("kind", F.lit("text"))).join(profile._measured(typed, keys, True), keys, "left")
    ends = parts.where("ends IS NOT NULL").join(kinds, keys)
    ends = ends.select(*keys, "file", "block", F.get("ends", F.when(F.col("kind") == "text", 0).otherwise(1)).alias("e")).select(*keys, "file", "block", "e.*")
    ends = ends.where("coalesce(first.number IS NOT NULL, false) OR first.text IS NOT NULL")
    steady = profile._joined_ends(ends, keys, ["file", "block"])
    rows = profile._ratios(rows.withColumn("dtype", F.lit("string"))).join(steady, keys, "left")
    rows = rows.withColumn("monotonic", F.coalesce("monotonic", F.lit(False)) & (F.col("cardinality_ratio") > profile.ROWS_EACH))
    return profile.decided(rows).withColumnRenamed("unit", "file")
