"""Rows by their content: a key for each row that needs no written copy of the table.

The key is two hashes of all columns by different functions: xxhash64 over the values, each followed by whether it is null,
and 60 bits of MD5 over a text from which every value, its length and its nulls could be read back. Arrays, structs and maps
count as JSON with their nulls. Rows that share the key are taken to be equal in every column, so it makes no difference
which of them is meant: a stage called exact goes by these 124 bits here. Whatever is decided about a key holds for all
tasks, plans and reruns alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.names import all_columns, col, free


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the two halves of each row's key, and their names, which clash with no column."""
    nested = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    plain = [F.to_json(F.struct(col(n)), nested) if t.startswith(("array<", "struct<", "map<")) else col(n) for n, t in docs.dtypes]
    flagged = [c for v in plain for c in (v, v.isNull())]
    texts = [F.base64(v) if t == "binary" else v.cast("string") for v, (_, t) in zip(plain, docs.dtypes, strict=True)]
    whole = F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])
    more = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")
    names = [free(docs.columns, "__key"), free(docs.columns, "__more")]
    return docs.select(*all_columns(docs), F.xxhash64(F.lit(0), *flagged).alias(names[0]), more.alias(names[1])), names


def chosen(docs: DataFrame, picks: DataFrame, more: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose keys are in ``picks(r1, r2, c, ..)``, once each; with ``more``, an array of ``picks``,
    a row and a column ``__more`` of this name for each of its elements. ``c`` is how many rows of ``docs`` share the key."""
    rows, (a, b) = keyed_rows(docs)
    extra = [] if more is None else [more.alias("m")]
    joined = rows.join(picks.select(F.col("r1").alias(a), F.col("r2").alias(b), F.col("c").alias("c"), *extra).withColumnRenamed("c", c := free(rows.columns, "__c")).withColumnRenamed("m", m := free(rows.columns, "__m")), [a, b])
    if not picks.where("c > 1").isEmpty():
        joined = joined.where(F.col(c) == 1).unionByName(joined.where(F.col(c) > 1).dropDuplicates([a, b]))
    if more is None:
        return joined.select(*all_columns(docs))
    return joined.select(*all_columns(docs), F.explode(m).alias(free(docs.columns, "__more")))
