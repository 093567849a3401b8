"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Targets: sources in code point order (null last) take the weights in turn and share ``budget`` times all words; a
source stops at ``most`` times its size, and what it leaves is shared by weight again. With caps ``c`` and weights
``w`` the level L with sum(min(c, L*w)) = total is the largest of (total - caps of the sources before) / (weights from
here on), in the order of c/w, so it takes one sort instead of rounds.

Curriculum: the weight of a source changes over the training time from 0 to 1; its schedule is piecewise linear.
The integral of the schedule, scaled to the source's target, is its demand so far. The documents of a source, in an
order given by a hash of their id, fill that demand one after the other, the whole source again when it is used up.
The position of a document is the time at which the demand reaches its first word: the inverse of the integral.
Sorting all sources' documents by position, by range, gives the training order.

Scale: one shuffle of (id, source, size) by range of (source, hash), so a source with a third of all rows spreads
over many partitions; running sums come from the partitions' totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix import running
from tidemark.llm.rows import chosen, keyed_rows
from tidemark.names import all_columns, col, free
from tidemark.scratch import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: For each weight in turn, its factor at training times (time, factor): falling, level, rising.
SCHEDULE = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """When the integral of a piecewise linear schedule reaches ``share`` of its whole: a quadratic a segment."""
    areas = [(b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:], strict=False)]
    done, out = 0.0, None
    whole = sum(areas)
    for k, ((a, x), (b, y)) in enumerate(zip(knots, knots[1:], strict=False)):
        area = share * F.lit(whole) - F.lit(done)
        slope = (y - x) / (b - a)
        under = F.greatest(F.lit(x * x) + F.lit(2 * slope) * area, F.lit(0.0))
        at = F.lit(a) + F.lit(2.0) * area / (F.lit(x) + F.sqrt(under))
        done += areas[k]
        out = F.when(share * F.lit(whole) <= F.lit(done), at) if out is None else out.when(share * F.lit(whole) <= F.lit(done), at)
    return F.least(F.greatest(out.otherwise(F.lit(knots[-1][0])), F.lit(knots[0][0])), F.lit(knots[-1][0]))


def targets(sizes: DataFrame, weights: Sequence[int], budget: float, most: int) -> DataFrame:
    """``(no_source, src, slot, source_size, target)``: a row for each source. ``sizes``: no_source, src, size."""
    per = saved(sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size")), "sources")
    per = running(per.withColumn("one", F.lit(1).cast("long")), [], ["no_source", "src"], {"rank": "one"})
    per = per.withColumn("slot", (F.col("rank") % len(weights)).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("slot") + 1).cast("long"))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("long")).withColumn("fill", F.col("cap") / F.col("weight"))
    per = running(per.drop("one", "rank"), [], ["fill", "no_source", "src"], {"caps": "cap", "weights": "weight"})
    whole = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = per.crossJoin(F.broadcast(whole)).agg(F.max((F.lit(float(budget)) * F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights"))).alias("level"))  # one row
    return per.crossJoin(F.broadcast(level)).select("no_source", "src", "slot", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def assign(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, schedule: Sequence[Sequence[tuple[float, float]]] = SCHEDULE, budget: float = 1.5, most: int = 2, whole: bool = False
) -> DataFrame:
    """``sizes(id, .., source, size)`` with source_size, target, taken and, for each pass, its words and position.

    ``firsts`` and ``agains`` are the words that the first and the later passes take of a document; at the end of the
    demand a document may be taken in part, so a source's words differ from its target by less than one. Positions
    are null where nothing is taken. With ``whole`` that last document is taken whole or not at all, whichever is nearer
    to the demand. A null or negative size counts as 0. Equal rows get equal or adjacent places;
    which of them comes first makes no difference to the result.
    """
    base = sizes.withColumn("no_source", F.col("source").isNull()).withColumn("src", F.coalesce("source", F.lit("")))
    base = base.withColumn("size", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long"))
    base = base.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    base = saved(base, "sizes")  # words are counted once; the range sort and the targets read numbers
    rows = running(base, ["no_source", "src"], ["key", "id", "size"], {"before": "size"})
    rows = rows.join(saved(targets(base.select("no_source", "src", "size"), weights, budget, most), "targets"), ["no_source", "src"])
    demand = F.floor(F.col("target") + 0.5)
    left = lambda start: F.least(F.greatest(demand - start, F.lit(0)), F.col("size"))
    part = (lambda start: F.when(2 * left(start) >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))) if whole else left
    rows = rows.withColumn("firsts", part(F.col("before")))
    for k in range(1, most):
        rows = rows.withColumn(f"agains{k}", part(F.col("before") + k * F.col("source_size")))
    passes = ["firsts", *[f"agains{k}" for k in range(1, most)]]
    places = []
    for k, taken in enumerate(passes):
        share = (F.col("before") + k * F.col("source_size")) / F.greatest(demand, F.lit(1)).cast("double")
        at = F.lit(None).cast("double")
        for slot, knots in reversed(list(enumerate(schedule))):
            at = F.when(F.col("slot") == slot, time_of(share, knots)).otherwise(at)
        places.append(F.when(F.col(taken) > 0, at))
    out = rows.withColumn("taken", sum((F.col(p) for p in passes[1:]), F.col(passes[0])))
    return out.withColumn("positions", F.array(*places)).withColumn("words", F.array(*passes)).drop("key", "no_source", "src", "slot", "before", *passes)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, **options) -> DataFrame:
    """The training order: the columns of ``docs``, a row for each pass that takes the document, sorted by position.

    Documents go whole: where the demand of a source ends inside one, it is taken if that is nearer to the demand.
    Documents without words take no part, since a mix counts words. Rows with null, equal or repeated ids and extra
    columns of any name stay as they are; of rows that are equal in all columns, one stands for all and is written as often
    as they are taken. ``docs`` is read twice. Empty tables give empty results.
    """
    rows, (a, b) = keyed_rows(docs)
    sizes = rows.select(F.col(a).alias("r1"), F.col(b).alias("r2"), col(id_col).alias("id"), col(source_col).alias("source"), n_words(col(text_col)).alias("size"))
    plan = assign(sizes, weights, whole=True, **options).where("taken > 0")
    plan = plan.groupBy("r1", "r2").agg(F.count("*").alias("c"), F.flatten(F.collect_list(F.filter("positions", lambda x: x.isNotNull()))).alias("places"))
    out, place = chosen(docs, saved(plan, "plan"), F.col("places")), free(docs.columns, "__more")
    return out.repartitionByRange(place, col(id_col)).sortWithinPartitions(place, col(id_col)).select(*all_columns(docs))
