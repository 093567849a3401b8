"""Column profiles: what kind of feature each column of a table, or of every file below a folder, is.

Types come from the schema; a text column of which more than ``PARSED`` of the values are numbers counts as numeric. All columns
share one aggregation in long form, combined before the shuffle: exact counts of values, or with ``sketches`` a distinct-count
sketch and a sketch of heavy hitters for each column, so that columns of many different values shuffle a few kilobytes a task.
The monotonic test needs an order; each range of rows is summed up for each column as (first, last, up, down), and these
records are compared in order, in one plan for any number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.drift import category_key
from tidemark.operators.trials import sample
from tidemark.scratch import saved

PARSED, CONSTANT, ROWS_EACH, IDENTIFIER, FREE_TEXT = 0.80, 0.99, 0.85, 0.95, 0.50
TEXT_KINDS, INT_KINDS, CODE_SHARE, CODE_LENGTH, CODE_SPREAD = 50, 20, 0.75, 6.0, 4.0
#: What a number looks like, and an identifier with a separator.
NUMBER, WHOLE, CODE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^\s*[+-]?\d+\s*$", r"(?i)^[A-Z0-9]{3,}[._\-/][A-Z0-9]{2,}"
INTEGERS, FLOATS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def kind_of(dtype: str) -> str:
    """int, float, datetime, bool or text."""
    if dtype in INTEGERS:
        return "int"
    if dtype in FLOATS or dtype.startswith("decimal"):
        return "float"
    return "datetime" if dtype.startswith(("timestamp", "date")) else "bool" if dtype == "boolean" else "text"


def coerced(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with mostly numeric text columns as numbers, the rest of their values null; and every column's kind."""
    kinds = {n: kind_of(t) for n, t in df.dtypes}
    texts = [n for n, k in kinds.items() if k == "text"]
    if not texts:
        return df, kinds
    q = {n: F.col(f"`{n}`").cast("string") for n in texts}
    shares = [F.struct(F.avg(q[n].rlike(NUMBER).cast("int")).alias("number"), F.avg(q[n].rlike(WHOLE).cast("int")).alias("whole")).alias(f"c{k}") for k, n in enumerate(texts)]
    row = df.agg(*shares).first()  # one row
    for k, n in enumerate(texts):
        if (row[k]["number"] or 0.0) > PARSED:
            kinds[n] = "int" if row[k]["whole"] == 1.0 else "float"
    pick = [F.when(q[n].rlike(NUMBER), F.trim(q[n]).try_cast("double")).alias(n) if n in q and kinds[n] != "text" else F.col(f"`{n}`") for n in df.columns]
    return df.select(*pick), kinds


#: How values of a kind are compared: as whole numbers, numbers or text.
_COMPARED = {"int": "whole", "bool": "whole", "datetime": "whole", "float": "number", "text": "text"}
_END = "struct<whole:long,number:double,text:string>"


def monotonic(df: DataFrame, features: list[str], order: str) -> DataFrame:
    """``feature, monotonic``: values never fall or never rise in the order of ``order``; nulls and NaN are skipped.

    Rows are dealt out by range of ``order`` and sorted there; one pass over a range gives a row for each column.
    """
    dtypes = dict(df.dtypes)
    kinds = [_COMPARED[kind_of(dtypes[f])] for f in features]

    def plain(f: str) -> Column:
        c, kind = F.col(f"`{f}`"), kind_of(dtypes[f])
        return F.unix_micros(c.cast("timestamp")) if kind == "datetime" else c.cast({"whole": "long", "number": "double", "text": "string"}[_COMPARED[kind]])

    ends = pa.struct([("whole", pa.int64()), ("number", pa.float64()), ("text", pa.string())])
    schema = pa.schema([("c", pa.int32()), ("at", pa.int32()), ("up", pa.bool_()), ("down", pa.bool_()), ("first", ends), ("last", ends)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[True, True, None, None] for _ in features]
        for batch in batches:
            for k, end in enumerate(found):
                values = batch.column(k).drop_null()
                if kinds[k] == "number":
                    values = values.filter(pc.invert(pc.is_nan(values)))
                if not len(values):
                    continue
                if end[3] is not None:
                    values = pa.concat_arrays([pa.array([end[3]], values.type), values])
                else:
                    end[2] = values[0].as_py()
                after, before = values.slice(1), values.slice(0, len(values) - 1)
                end[0] &= pc.all(pc.greater_equal(after, before), min_count=0).as_py()
                end[1] &= pc.all(pc.less_equal(after, before), min_count=0).as_py()
                end[3] = values[-1].as_py()
        at = TaskContext.get().partitionId()
        value = lambda k, v: {n: v if n == kinds[k] else None for n in ("whole", "number", "text")}
        yield pa.RecordBatch.from_pylist([{"c": k, "at": at, "up": u, "down": d, "first": value(k, a), "last": value(k, b)} for k, (u, d, a, b) in enumerate(found) if b is not None], schema)

    rows = df.select(*[plain(f).alias(f"f{k}") for k, f in enumerate(features)], F.col(f"`{order}`").alias("__o")).repartitionByRange("__o").sortWithinPartitions("__o")
    parts = saved(rows.mapInArrow(summed, f"c int, at int, up boolean, down boolean, first {_END}, last {_END}"), "ends")  # a row a range and column
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "c int, feature string")
    return names.join(_joined_ends(parts, ["c"], ["at"]), "c", "left").select("feature", F.coalesce("monotonic", F.lit(False)).alias("monotonic"))


def _joined_ends(parts: DataFrame, column: list[str], order: list[str]) -> DataFrame:
    """``<column>, monotonic`` from ``parts(<column>, <order>, up, down, first, last)``, a row for each range and column; null is no objection."""
    parts = parts.where("first IS NOT NULL").withColumn("prev", F.lag("last").over(Window.partitionBy(*column).orderBy(*order)))
    steady = lambda side, border: F.bool_and(F.coalesce(F.col(side), F.lit(True)) & F.coalesce(border, F.lit(True)))
    return parts.groupBy(*column).agg((steady("up", F.col("first") >= F.col("prev")) | steady("down", F.col("first") <= F.col("prev"))).alias("monotonic"))


#: Size of the sketches: logarithm of the distinct-count sketch's registers, and heavy hitters tracked for each column.
REGISTERS, TRACKED = 14, 1000


def _measured(cells: DataFrame, keys: list[str], counted: bool) -> DataFrame:
    """A row for each of ``keys``, over ``cells(<keys>, kind, v)`` or, if ``counted``, ``cells(<keys>, kind, v, n)`` with a row a value.

    Without counts the number of different values comes from a sketch (standard error 0.8 %, small numbers exact) and the
    most frequent value from another (exact up to TRACKED different values).
    """
    text = F.col("kind") == "text"
    number = F.when(F.col("kind").isin("int", "float"), F.col("v").try_cast("double"))
    length, weight = F.when(text & F.col("v").isNotNull(), F.length("v")).cast("double"), F.col("n") if counted else F.lit(1).cast("long")
    total, squares, weights = F.sum(length * weight), F.sum(length * length * weight), F.sum(F.when(length.isNotNull(), weight))
    spread = F.when(weights > 1, F.sqrt(F.greatest((squares - total * total / weights) / (weights - 1), F.lit(0.0)))).otherwise(F.lit(0.0))
    there = F.when(F.col("v").isNotNull(), weight)
    if counted:
        unique, top = F.count("v"), F.max(there)
    else:
        unique = F.hll_sketch_estimate(F.hll_sketch_agg("v", F.lit(REGISTERS)))
        top = F.get(F.filter(F.expr(f"approx_top_k(v, 2, {TRACKED})"), lambda x: x["item"].isNotNull()), F.lit(0))["count"]
    return cells.groupBy(*keys).agg(
        F.sum(weight).alias("n_rows"), F.coalesce(F.sum(there), F.lit(0)).alias("n_values"), F.coalesce(unique, F.lit(0)).alias("n_unique"), top.alias("top"),
        F.coalesce(total / weights, F.lit(0.0)).alias("mean_length"), F.coalesce(spread, F.lit(0.0)).alias("length_std"),
        F.coalesce(F.sum(F.when(F.col("v").rlike(CODE), length * 0 + weight).otherwise(length * 0)) / weights, F.lit(0.0)).alias("code_share"),
        F.coalesce(F.max(number) - F.min(number), F.lit(0.0)).alias("value_range"),
    )


def _ratios(rows: DataFrame) -> DataFrame:
    """The shares that the cascade reads; an empty column has 0 and 1."""
    rows = rows.na.fill(0, ["n_rows", "n_values", "n_unique"]).na.fill(0.0, ["mean_length", "length_std", "code_share", "value_range"])
    rows = rows.withColumn("n_unique", F.least("n_unique", "n_values"))
    rows = rows.withColumn("cardinality_ratio", F.when(F.col("n_values") > 0, F.col("n_unique") / F.col("n_rows")).otherwise(0.0))
    return rows.withColumn("dominant_ratio", F.when(F.col("n_values") > 0, F.least(F.coalesce("top", F.lit(1)), F.col("n_values")) / F.col("n_values")).otherwise(1.0)).drop("top")


def signals(df: DataFrame, order: str | None = None, sketches: bool = False) -> DataFrame:
    """A row a column: name, dtype, kind, n_rows, n_values, n_unique, cardinality_ratio (of all rows), dominant_ratio (of
    values), mean_length, length_std, code_share, value_range, monotonic. An empty column has ratios 0 and 1."""
    typed, kinds = coerced(df)
    dtypes, names = dict(df.dtypes), df.columns
    now = dict(typed.dtypes)
    value = lambda n: F.when(F.isnan(f"`{n}`"), None).otherwise(category_key(F.col(f"`{n}`"), now[n])) if now[n] in FLOATS else F.col(f"`{n}`").cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.lit(kinds[n]).alias("kind"), value(n).alias("v")) for k, n in enumerate(names)]))
    cells = typed.select(pairs.alias("p")).select("p.*")
    per = _measured(cells if sketches else cells.groupBy("c", "kind", "v").agg(F.count("*").alias("n")), ["c"], not sketches)
    facts = df.sparkSession.createDataFrame([(k, n, dtypes[n], kinds[n]) for k, n in enumerate(names)], "c int, name string, dtype string, kind string")
    out = _ratios(facts.join(per, "c", "left").drop("c"))
    if order is None:
        return out.withColumn("monotonic", F.lit(False))
    steady = monotonic(typed, names, order).withColumnRenamed("feature", "name")
    return out.join(steady, "name", "left").withColumn("monotonic", F.coalesce("monotonic", F.lit(False)) & (F.col("cardinality_ratio") > ROWS_EACH))


def decision(text_kinds: int = TEXT_KINDS, int_kinds: int = INT_KINDS) -> Column:
    """``reason_code`` of a row of signals; the first rule that holds decides."""
    kind, unique, ratio = F.col("kind"), F.col("n_unique"), F.col("cardinality_ratio")
    code = (F.col("code_share") > CODE_SHARE) & (F.col("mean_length") > CODE_LENGTH)
    return (
        F.when(F.col("n_values") == 0, "empty")
        .when((F.lower("name") == "time") & (kind == "int") & (unique == F.col("n_rows")), "time_index")
        .when((F.col("dominant_ratio") > CONSTANT) & (unique <= 5), "near_constant")
        .when(kind == "datetime", "datetime")
        .when(F.col("monotonic"), "monotonic")
        .when((kind == "text") & (unique <= text_kinds), "few_texts")
        .when((kind == "int") & (unique <= int_kinds), "few_integers")
        .when(kind.isin("float", "int"), "numbers")
        .when((kind == "text") & code & (F.col("length_std") < CODE_SPREAD), "code")
        .when(ratio > IDENTIFIER, "identifier")
        .when((kind == "text") & (ratio > FREE_TEXT) & ~code, "free_text")
        .otherwise("unclear")
    )


def profile(df: DataFrame, order: str | None = None, sketches: bool = False, sample_key: str | None = None, sample_rows: int = 50_000) -> DataFrame:
    """Signals with reason_code, decision (continuous, categorical, ignore, review) and best_guess for columns to review.

    With ``sample_key`` the profile is that of ``sample_rows`` rows, the first in the order of a hash of that column.
    """
    return decided(signals(df if sample_key is None else sample(df, sample_key, sample_rows), order, sketches))


def decided(rows: DataFrame) -> DataFrame:
    """Rows of signals with reason_code, decision and best_guess."""
    out = rows.withColumn("reason_code", decision())
    kind = F.when(F.col("reason_code").isin("few_texts", "few_integers"), "categorical").when(F.col("reason_code") == "numbers", "continuous").when(F.col("reason_code") == "unclear", "review").otherwise("ignore")
    guess = F.when(F.col("kind").isin("int", "float"), "continuous").when((F.col("kind") == "text") & (F.col("n_unique") <= TEXT_KINDS), "categorical").otherwise("ignore")
    return out.withColumn("decision", kind).withColumn("best_guess", F.when(F.col("decision") == "review", guess))


def routes(profiles: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``name, kind`` of the columns to watch. ``overrides(name, role)`` wins over the decision; ignore and review are left out."""
    role = F.when(F.col("decision") == "review", F.coalesce("best_guess", F.lit("review"))).otherwise(F.col("decision"))
    rows = profiles.select("name", role.alias("kind"))
    if overrides is not None:
        rows = rows.join(overrides.select("name", "role"), "name", "left").select("name", F.coalesce("role", "kind").alias("kind"))
    return rows.where(F.col("kind").isin("continuous", "categorical"))
