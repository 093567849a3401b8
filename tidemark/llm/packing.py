"""Packing documents into sequences by minimum bin slack.

A document's ids are cut into whole sequences and one shorter rest. How the rests share sequences depends only on how
many there are of each length, at most ``capacity - 1`` numbers. For the longest rest left, a subset-sum dynamic
program over bitsets finds what can fill the remaining room and takes the fill with the least padding; backtracking
gives how many rests of each length it uses. The pattern is repeated as often as the counts allow, so the number of
patterns depends on the capacity, not on the number of documents. Then every rest finds its place from its rank among
the rests of its length.

Scale: only the histogram (under ``capacity`` rows) comes to the driver, and the patterns go back in the tasks'
closure. Ranks are a number within the task that cut the piece plus the tasks' totals before it, so no window runs
over all rests of a length, however many are alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.batches import batch, columns, small_batches
from tidemark.llm.tokens import encoding
from tidemark.names import col
from tidemark.scratch import saved

CAPACITY = 1024


def padding(filled: int, capacity: int) -> int:
    """Ids of padding a sequence gets: up to the capacity, none if its length is a power of two."""
    return 0 if filled & (filled - 1) == 0 else capacity - filled


def best_fill(lengths: list[int], counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The multiset of rests, one of length ``seed`` among them, whose sequence needs the least padding."""
    room = capacity - seed
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length] - (length == seed), room // length)
        if left <= 0:
            continue
        before, step, total = reach, 1, left
        while left > 0:  # 1, 2, 4 .. copies reach every number of copies
            step = min(step, left)
            reach |= reach << step * length & mask
            left -= step
            step *= 2
        steps.append((length, total, before))
        if reach >> room & 1:
            break
    reachable = (k for k in range(room, -1, -1) if reach >> k & 1)
    fill = min(reachable, key=lambda k: (padding(seed + k, capacity), -k))
    used, rest = {seed: 1}, fill
    for length, total, before in reversed(steps):
        n = 0
        while not before >> rest & 1:  # the fewest copies of the later, shorter lengths
            rest -= length
            n += 1
        if n:
            used[length] = used.get(length, 0) + n
        assert n <= total
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, {length: copies})`` until every rest has a place. The longest rest left starts each pattern."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        used = best_fill(lengths, counts, lengths[0], capacity)
        repeats = min(counts[k] // n for k, n in used.items())
        out.append((repeats, used))
        for k, n in used.items():
            counts[k] -= n * repeats
            if not counts[k]:
                del counts[k]
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies, offset in the sequence), in order of rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for repeats, used in patterns:
        offset = 0
        for length, n in used.items():
            rows.setdefault(length, []).append((taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + repeats * n
            offset += length * n
        sequence += repeats
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, with the task that cut them and their number among its pieces of that length."""
    small_batches(docs.sparkSession)

    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "ids_crc32", "task", "number")] + [("ids", pa.binary())] * with_ids

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tail = TaskContext.get().partitionId(), np.array([end_id], "<u2").tobytes()
        seen = [0] * (capacity + 1)
        with encoding(tokenizer) as encode:
            for docs, texts in columns(parts, "id", "text"):
                out = []
                for doc, text in zip(docs, texts, strict=True):
                    ids = np.frombuffer(encode(text) + tail, "<u2")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        out.append((doc, start, len(piece), len(ids), zlib.crc32(piece.astype("<u4").tobytes()), task, seen[len(piece)], *[piece.tobytes()] * with_ids))
                        seen[len(piece)] += 1
                yield batch(out, fields)

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, from_arrow_schema(pa.schema(fields)))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 16 bits each).

    Null and empty texts are the end id alone. Each row of ``docs`` is a document of its own, whatever its id; a null
    id stays null; an id that is no whole number is an error; other columns are not read. Sequences with several pieces have the first numbers, whole pieces the ones after. An empty table
    gives an empty result.
    """
    made = saved(cut(docs, tokenizer, end_id, capacity, with_ids, id_col, text_col), "pieces")
    per_task = saved(made.groupBy("length", "task").count(), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in per_task.where(F.col("length") < capacity).groupBy("length").agg(F.sum("count")).collect()}  # under `capacity` rows
    patterns = plan(histogram, capacity)
    places, shared = _places(patterns), sum(r for r, _ in patterns)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, earlier, number = (part.column(n).to_numpy() for n in ("length", "earlier", "number"))
            rank = earlier + number
            sequence, offset = shared + rank, np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                if k < capacity:
                    at = np.flatnonzero(length == k)
                    rows = places[int(k)]
                    first, base, n, start = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                    sequence[at], offset[at] = base + (rank[at] - first) // n, start + (rank[at] - first) % n * k
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = made.join(offsets, ["length", "task"]).select(*names, "earlier", "number")
    kept = ", ".join(f"{n} {t}" for n, t in ranked.dtypes[: len(names)])
    return ranked.mapInArrow(place, kept + ", sequence_id long, offset long")
