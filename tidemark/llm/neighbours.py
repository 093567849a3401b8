"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. A unit vector, rotated, is nearest to
one signed axis; that axis is its hash. A table's bucket joins the axes of a few rotations, the last of them over
only as many coordinates as the number of rows asks for. A query looks up its own bucket of each table and, by
the rotated coordinates, those that it misses most narrowly. Whatever is found is ranked in blocks, and the best are
ranked again by their exact cosine.

Scale: vectors of equal direction (up to a power of two) share one row with their smallest ids (``k + 1``, all that can
ever be among the nearest), so a group of copies is one candidate. Vectors and queries are dealt out by (table,
bucket), and a task multiplies each bucket's queries with its rows and sends on the few best of each query. A bucket of over ``BLOCK`` rows or queries, such as
that of many near-equal vectors, is split into blocks of that size.

Recall: a bounded sample of the queries is first compared with all rows, a block of rows in a task at a time. The number of
probes is doubled until the sample's true neighbours are found at the wanted share, whatever the size of the
table; if the buckets would then hold about as many rows as the table, one table is enough and all its buckets are
probed. So are they for queries that found fewer than ``k`` neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.names import col
from tidemark.scratch import saved

TABLES, PROBES, PER_BUCKET = 10, 24, 48
#: Rows or queries of a bucket that are multiplied at once, buckets that are probed together when all are, hot buckets that are broadcast at most.
BLOCK, TOGETHER, MOST_HOT = 2048, 32, 100_000
#: Pairs that a task holds before it cuts them to the best of each query.
HELD = 1_000_000
#: Share of the sampled queries' true neighbours that the buckets must hold, and how many queries are sampled.
RECALL, SAMPLE = 0.95, 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, orthonormal. The width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def shape_for(rows: int, width: int, per_bucket: int = PER_BUCKET) -> list[int]:
    """Coordinates used by each rotation of a table, so that a bucket holds about ``per_bucket`` of ``rows`` rows."""
    wanted, out = max(2.0, rows / per_bucket), []
    while wanted > 1.5 and len(out) < 8:
        take = int(min(width, 1 << max(0, round(np.log2(wanted / 2)))))
        out.append(take)
        wanted /= 2 * take
    return out


def rotated(x: np.ndarray, table: int, shape: list[int], seed: int) -> list[np.ndarray]:
    """The rotated coordinates of a table, an array for each of its hashes."""
    out = []
    for k, take in enumerate(shape):
        signs = np.random.default_rng([seed, table, k]).choice([-1.0, 1.0], (3, x.shape[1]))
        y = x
        for s in signs:
            y = hadamard(y * s)
        out.append(y[:, :take])
    return out


def buckets(x: np.ndarray, shape: list[int], tables: int, probes: int, seed: int) -> np.ndarray:
    """For each row and table, its ``probes`` best buckets, best first; -1 where there are fewer."""
    out = np.full((len(x), tables, probes), -1, np.int64)
    for t in range(tables):
        best: tuple[np.ndarray, np.ndarray] = (np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64))
        for y in rotated(x, t, shape, seed):
            both = np.concatenate([y, -y], axis=1)
            m = min(probes, both.shape[1])
            axis = np.argsort(-both, axis=1, kind="stable")[:, :m]
            top = np.take_along_axis(both, axis, 1)
            loss = (top[:, :1] - top) ** 2  # how far the vector is from having that axis
            total = (best[0][:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            code = (best[1][:, :, None] * both.shape[1] + axis[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(total, axis=1, kind="stable")[:, :probes]
            best = np.take_along_axis(total, keep, 1), np.take_along_axis(code, keep, 1)
        out[:, t, : best[1].shape[1]] = best[1]
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as unit vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame, width: int, shape: list[int], tables: int, probes: int, seed: int) -> DataFrame:
    """``vectors(.., u)`` with ``keys``: for each table and probe a key."""
    pad = (1 << max(0, width - 1).bit_length()) - width
    names = vectors.columns

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 1024):
                piece = part.slice(k, 1024)
                x = np.pad(matrix(piece.column("u"), width), ((0, 0), (0, pad)))
                found = buckets(x, shape, tables, probes, seed)
                found = np.where(found < 0, -1, found * tables + np.arange(tables)[:, None]).reshape(len(x), -1)
                keys = pa.array([row[row >= 0].tolist() for row in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), keys], [*names, "keys"])

    fields = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(of, fields + ", keys array<bigint>")


def nearest(vectors: DataFrame, asked: np.ndarray, most: int) -> np.ndarray:
    """For each row of ``asked`` (unit vectors) its ``most`` nearest of all ``vectors(u)``: an array of unit vectors.

    A task multiplies block by block and keeps the best; the driver gets ``most`` rows a query and task.
    """

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, kept = np.full((len(asked), 0), 0.0), np.zeros((len(asked), 0, asked.shape[1]))
        for part in parts:
            for k in range(0, part.num_rows, 1024):
                x = matrix(part.slice(k, 1024).column("u"), asked.shape[1])
                here = asked @ x.T
                top = np.argsort(-here, axis=1, kind="stable")[:, :most]
                score = np.concatenate([score, np.take_along_axis(here, top, 1)], axis=1)
                kept = np.concatenate([kept, x[top]], axis=1)
                best = np.argsort(-score, axis=1, kind="stable")[:, :most]
                score, kept = np.take_along_axis(score, best, 1), np.take_along_axis(kept, best[:, :, None], 1)
        if score.shape[1]:
            n, m = score.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), m)), pa.array(score.ravel()), pa.array(list(kept.reshape(n * m, -1)), pa.list_(pa.float64()))], ["q", "score", "u"])

    found = vectors.select("u").mapInArrow(of, "q long, score double, u array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    rows = found.withColumn("place", place).where(F.col("place") <= most).orderBy("q", "place").select("u").collect()
    return np.array([r[0] for r in rows]).reshape(len(asked), -1, asked.shape[1])


def probes_for(asked: np.ndarray, near: np.ndarray, rows: int, shape: list[int], tables: int, probes: int, per_bucket: int, seed: int, recall: float) -> int | None:
    """The least number of probes, doubled from ``probes``, at which a bucket of the query holds ``recall`` of its ``near``.

    None if that many buckets hold about as many rows as there are: then one table, probed as a whole, costs less.
    """
    pad = (1 << max(0, asked.shape[1] - 1).bit_length()) - asked.shape[1]
    wide = lambda x: np.pad(x, ((0, 0), (0, pad)))
    homes = buckets(wide(near.reshape(-1, near.shape[2])), shape, tables, 1, seed).reshape(*near.shape[:2], tables, 1)
    while tables * probes * per_bucket < rows:
        ways = buckets(wide(asked), shape, tables, probes, seed)[:, None]
        if (ways == homes).any(axis=(2, 3)).mean() >= recall:
            return probes
        probes *= 2
    return None


def _split(right: DataFrame, left: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part`` and ``qpart``: rows and queries of a hot key in parts of ``block``, every part against every part."""
    counts = right.groupBy("key").count().select("key", F.ceil(F.col("count") / block).alias("parts"), F.lit(1).cast("long").alias("qparts"))
    counts = counts.unionByName(left.groupBy("key").count().select("key", F.lit(1).cast("long").alias("parts"), F.ceil(F.col("count") / block).alias("qparts")))
    hot = saved(counts.groupBy("key").agg(F.max("parts").alias("parts"), F.max("qparts").alias("qparts")).where("parts > 1 OR qparts > 1"), "hot-buckets")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    one = F.lit(1).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, one) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vid"), F.coalesce(n, one))
    right = right.join(hot, "key", "left").select("key", mine(F.col("parts")).alias("part"), each(F.col("qparts")).alias("qpart"), "vid", "u")
    left = left.join(hot, "key", "left").select("key", each(F.col("parts")).alias("part"), mine(F.col("qparts")).alias("qpart"), "vid", "u")
    return right, left


def few_best(held: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of columns ``(qv, vid, near)`` the distinct pairs with the ``most`` best ``vid`` of each ``qv``; ties to the smaller."""
    qv, vid, near = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((-near, vid, qv))
    qv, vid, near = qv[order], vid[order], near[order]
    new = np.concatenate([[True], (qv[1:] != qv[:-1]) | (vid[1:] != vid[:-1])])
    qv, vid, near = qv[new], vid[new], near[new]
    order = np.lexsort((vid, -near, qv))
    qv, vid, near = qv[order], vid[order], near[order]
    start = np.searchsorted(qv, qv, "left")
    keep = np.arange(len(qv)) - start < most
    return qv[keep], vid[keep], near[keep]


def best_pairs(right: DataFrame, left: DataFrame, width: int, most: int, block: int = BLOCK) -> DataFrame:
    """``(qv, vid, near)``: the ``most`` best rows of each query among those that share a key; both sides are ``(key, vid, u)``."""
    right, left = _split(right, left, block)
    both = right.withColumn("asks", F.lit(False)).unionByName(left.withColumn("asks", F.lit(True)))
    group = ["key", "part", "qpart"]

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def best(vid: np.ndarray, asks: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            n = len(vid) - int(asks.sum())
            if n == 0 or n == len(vid):
                return
            for k in range(n, len(vid), 256):
                near = np.round(x[k : k + 256] @ x[:n].T, 13)
                top = np.argsort(-near, axis=1, kind="stable")[:, :most]  # rows are in the order of vid
                held.append((np.repeat(vid[k : k + 256], top.shape[1]), vid[:n][top].ravel(), np.take_along_axis(near, top, 1).ravel()))
                size += top.size
            if size > HELD:
                held = [few_best(held, most)]
                size = len(held[0][0])
                if size > HELD // 2:  # too many queries to keep: what they have so far goes on
                    yield from out()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in few_best(held, most)], ["qv", "vid", "near"])
            held, size = [], 0

        ids, vid, asks, x = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, width))
        for part in parts:
            ids = np.concatenate([ids, np.stack([part.column(n).to_numpy() for n in group], axis=1)])
            vid = np.concatenate([vid, part.column("vid").to_numpy()])
            asks = np.concatenate([asks, part.column("asks").to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, matrix(part.column("u"), width)])
            starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()]
            for i, j in zip(starts, starts[1:], strict=False):
                yield from best(vid[i:j], asks[i:j], x[i:j])
            last = starts[-1]  # its group may go on
            ids, vid, asks, x = ids[last:], vid[last:], asks[last:], x[last:]
        yield from best(vid, asks, x)
        yield from out()

    dealt = both.repartition(*group).sortWithinPartitions(*group, "asks", "vid")
    pairs = dealt.mapInArrow(of, "qv long, vid long, near double").groupBy("qv", "vid").agg(F.max("near").alias("near"))
    place = F.row_number().over(Window.partitionBy("qv").orderBy(F.col("near").desc(), "vid"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def search(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, probes: int = PROBES, seed: int = 11, per_bucket: int = PER_BUCKET, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, <id>, score``: the ``k`` nearest found of every row for which ``is_query`` holds.

    Null and zero vectors and those with null or non-finite components take no part, nor do rows with a null id; nor
    vectors whose width isn't the most frequent (the smaller of equals), since a cosine needs equal widths. Vectors are
    first divided by a power of two near their largest component, which changes no digit and keeps tiny and huge ones
    in range. Ties go to the smaller id. Rows with one id are one candidate each and one query if equal; a query's own
    id is never its neighbour. Other columns are not read. An empty table gives an empty result. ``probes`` is the
    least number of buckets a table; more are taken until ``recall`` is reached.
    """
    kind = "float" if dict(rows.dtypes)[vector_col] == "array<float>" else "double"
    base = rows.select(col(id_col).alias("id"), F.transform(col(vector_col), lambda x: x.cast("double")).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    base = base.where(F.coalesce(finite, F.lit(False)))
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x))))))
    base = base.withColumn("power", power).select("id", "q", F.transform("v", lambda x: (x / F.col("power") + 0.0).cast(kind)).alias("u"))
    base = saved(base, "usable")
    # Vectors of one direction become one: its smallest ids.
    ids = base.withColumn("place", F.row_number().over(Window.partitionBy("u", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")))
    few = ids.where(F.col("place") <= k + 1).groupBy("u").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    distinct = saved(few.withColumn("low", F.col("ids")[0]).orderBy("low").withColumn("vid", F.monotonically_increasing_id()), "vectors")  # vid in the order of the ids
    widths = distinct.groupBy(F.size("u").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        t = dict(base.dtypes)["id"]
        return rows.sparkSession.createDataFrame([], f"query_id {t}, rank int, `{id_col}` {t}, score double")
    width, n = widths
    distinct = distinct.where(F.size("u") == width)
    asked = saved(base.where("q").select(F.col("id").alias("query_id"), "u").distinct().join(distinct.select("u", "vid"), "u").select("query_id", F.col("vid").alias("qv")), "queries")
    shape = shape_for(n, width, per_bucket)
    asking = saved(distinct.join(asked.select(F.col("qv").alias("vid")).distinct(), "vid", "left_semi").select("vid", "u"), "asking")
    trial = [r[0] for r in asking.orderBy(F.xxhash64(F.lit(seed), "u"), "vid").limit(SAMPLE).select("u").collect()]
    if trial:
        trial = np.array(trial, np.float64)
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        probes = probes_for(trial, nearest(distinct, trial, k + 1)[:, 1:], n, shape, tables, probes, per_bucket, seed, recall)  # without the query itself
    homes = saved(keyed(distinct.select("vid", "u"), width, shape, tables if probes else 1, 1, seed), "homes")
    most = 2 * (k + 1)

    def everywhere(queries: DataFrame) -> DataFrame:
        """All buckets of the first table, some together."""
        count = tables if probes else 1
        together = F.floor(F.col("keys")[0] / (count * TOGETHER)).cast("long")
        last = int(np.prod([2 * take for take in shape], dtype=np.int64) - 1) // TOGETHER
        return best_pairs(homes.select(together.alias("key"), "vid", "u"), queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("key"), "vid", "u"), width, most)

    if probes:
        found = saved(best_pairs(homes.select(F.explode("keys").alias("key"), "vid", "u"), keyed(asking, width, shape, tables, probes, seed).select(F.explode("keys").alias("key"), "vid", "u"), width, most), "found")
        # Queries whose buckets hold too few ids.
        have = found.join(distinct.select("vid", F.size("ids").alias("m")), "vid").groupBy("qv").agg(F.sum("m").alias("m"))
        short = saved(asking.join(have.withColumnRenamed("qv", "vid"), "vid", "left").where(F.coalesce("m", F.lit(0)) < k + 1).select("vid", "u"), "short")
        if not short.isEmpty():
            found = found.join(short.select(F.col("vid").alias("qv")), "qv", "left_anti").unionByName(everywhere(short))
    else:
        found = everywhere(asking)
    pairs = found.join(asking.select(F.col("vid").alias("qv"), F.col("u").alias("w")), "qv").join(distinct.select("vid", "u", "ids"), "vid")
    exact = pairs.select("qv", (_dot("w", "u") / (F.sqrt(_dot("w", "w")) * F.sqrt(_dot("u", "u")))).alias("score"), F.explode("ids").alias("id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    out = asked.join(exact, "qv").where(F.col("query_id") != F.col("id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
