"""Column names: quoted for expressions, and new ones that clash with no other in any case."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name for SQL expressions, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The top-level column of exactly this name."""
    return F.col(quoted(name))


def all_columns(df: DataFrame) -> list[Column]:
    return [col(n) for n in df.columns]


def free(taken: Iterable[str], stem: str) -> str:
    """``stem``, with underscores until no name of ``taken`` equals it in any case, as Spark compares them."""
    low = {n.lower() for n in taken}
    while stem.lower() in low:
        stem += "_"
    return stem
