"""Periodic runs of words: tiles of each octave of periods, boundary Z-functions, fragments stitched by document and period.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that can't be extended. Where the words
of a run are compared with those q further on, at least 3 q in a row are equal. For the octave of periods P <= q < 2 P a
document is cut at every 2 P words into overlapping tiles, each around one boundary, from 2 P words before it to 3 P
words (and a period) after it. Those 3 q >= 3 P equal places hold P whole words to the right of some boundary, so a tile
whose first P words after the boundary occur nowhere P to 2 P further on has no part of a run; block hashes, doubled from
octave to octave, find the others by one comparison of arrays. In such a tile two Z-functions, one to each side of the
boundary as by Main and Lorentz (1984), give for every period how far equality reaches, exactly: a fragment. Fragments
whose root is itself a repetition belong to a smaller period and go.

Scale: tiles are solved where they are cut, so no tile travels. Documents without a fragment, nearly all, are finished
by the first task; of the others the fragments and the words are written once. Fragments are dealt out by (document,
period), joined where they touch, and the runs meet the words of their document again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import batch, columns
from tidemark.names import col
from tidemark.scratch import saved

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words whose tiles are searched at a time; a longer document is a group by itself.
GROUP = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, or for every tenth document by hash its words with a periodic tail. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def z_function(s: Sequence[int | None]) -> list[int]:
    """How many items from each place on equal those from the start on."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(s: Sequence[int], b: int, octave: int) -> list[tuple[int, int, int]]:
    """``(period, start, stop)`` in one tile: the places around boundary ``b`` that equal those a period further on.

    Periods are ``octave`` to ``2 octave - 1``; the reach is cut 2 ``octave`` places to the left and 3 to the right, where
    the next boundaries go on. With less than ``octave`` places to the right nothing is reported: the boundary before
    reaches as far. Nor are periods whose root is repeated, nor stretches that end inside the tile and are too short.
    """
    reach = 2 * octave
    after, before = s[b : b + 5 * octave], s[max(0, b - reach) : b]
    right = z_function(after)
    if not any(z >= octave for z in right[octave:reach]):
        return []
    pattern = before[::-1]
    left = z_function([*pattern, None, *s[max(0, b - reach) : b + reach][::-1]])
    whole, out = min(reach, len(s) - b), []
    for p in range(octave, min(reach, len(after))):
        if right[p] < octave or any(right[d] >= p - d for d in _divisors(p)):
            continue
        at = len(pattern) + 1 + whole - p  # where the words before b + p begin, read backwards
        back, on = min(left[at] if at < len(left) else 0, reach), min(right[p], 3 * octave)
        if back < reach and on < 3 * octave and back + on + p < max(LEAST_WORDS, LEAST_PERIODS * p):
            continue  # it ends on either side, and is no run
        out.append((p, b - back, b + on))
    return out


@lru_cache(1 << 16)
def _divisors(p: int) -> list[int]:
    """The divisors p / r for primes r: a root is a repetition only if it is one of such a length."""
    out, rest, r = [], p, 2
    while r * r <= rest:
        if rest % r == 0:
            out.append(p // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return [*out, p // rest] if rest > 1 else out


def fragments(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The fragments of each document, tile by tile, in word numbers."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = [len(d) for d in documents]
    starts = np.cumsum([1, *[n + 1 for n in sizes]])[:-1]
    ids = np.empty(int(sum(sizes)) + len(sizes) + 1, np.int64)
    ids[0] = -1
    for k, (d, at) in enumerate(zip(documents, starts.tolist(), strict=True)):
        ids[at : at + len(d)] = [numbers[w] for w in d]
        ids[at + len(d)] = -2 - k  # equal to nothing else, so no fragment leaves its document
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    with np.errstate(over="ignore"):
        block = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        block ^= block >> np.uint64(29)
        power, octave = _MIX | np.uint64(2), 1
        while LEAST_PERIODS * octave <= max(sizes, default=0):
            # block[i] is a hash of the ``octave`` words from i on.
            step = 2 * octave
            tiles = np.append(block, np.zeros(-len(block) % step, np.uint64)).reshape(-1, step)
            hits = np.flatnonzero((tiles[:, octave:] == tiles[:, :1]).any(axis=1)) * step
            for b in hits.tolist():
                low, high = max(0, b - step), b + 5 * octave
                k = int(np.searchsorted(starts, b, "right")) - 1
                if k < 0:
                    continue
                at = int(starts[k])
                for p, i, j in solve(ids[low:high].tolist(), b - low, octave):
                    out[k].append((p, i + low - at, j + low - at))
            block = block[:-octave] * power + block[octave:]
            power, octave = power * power, step
    return out


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows ``(.., words)`` in groups of about GROUP words."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


_FOUND = "rid long, doc_id long, plain string, words binary, fragments array<struct<period:long,start:long,stop:long>>"
_FIELDS = [("rid", pa.int64()), ("doc_id", pa.int64()), ("plain", pa.string()), ("words", pa.binary()), ("fragments", pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])))]


def tiled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False, texts: bool = False) -> DataFrame:
    """A row a document: a row id, the hash of its words joined by spaces and, only where it has fragments or with ``texts``, words and fragments."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for some in columns(parts, "rid", "doc_id", "text"):
                for rid, doc_id, text in zip(*some, strict=True):
                    words = words_of(text)
                    yield rid, doc_id, with_tail(words, doc_id) if tails else words

        for group in _groups(rows()):
            out = []
            for (rid, doc_id, words), found in zip(group, fragments([r[-1] for r in group]), strict=True):
                line = b" ".join(words)
                out.append((rid, doc_id, hashlib.sha256(line).hexdigest(), line if found or texts else None, [dict(zip(("period", "start", "stop"), f, strict=True)) for f in found] or None))
            yield batch(out, _FIELDS)

    read = docs.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return read.mapInArrow(search, _FOUND)


def stitched(found: DataFrame) -> DataFrame:
    """``rid, start, length, period``: fragments of one document and period that touch are one; the runs long enough stay."""
    each = found.where("fragments IS NOT NULL").select("rid", F.explode("fragments").alias("f")).select("rid", "f.*")
    near = Window.partitionBy("rid", "period").orderBy("start", "stop")
    reach = F.max("stop").over(near.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    chains = marked.withColumn("chain", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chains.groupBy("rid", "period", "chain").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + F.col("period")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))).select("rid", "start", "length", "period")


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


_RUNS = "array<struct<start:long,period:long,length:long>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False, texts: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed_sha256``, a row a document: its runs by start, then period, and the hash of its collapsed words.

    With ``texts`` the collapsed words too, joined by single spaces, as ``text``. Null and empty texts, and texts of white
    space, have no run and collapse to nothing. Repeated rows and ids, null ones too, are documents of their own. Texts of
    any length are searched whole. An empty table gives no rows; further columns are not read, whatever their names. With
    ``tails`` every tenth document by hash of its id gets a periodic tail first.
    """
    found = saved(tiled(docs, id_col, text_col, tails, texts), "fragments")
    runs = stitched(found).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # of one document
    hit = found.where("fragments IS NOT NULL").select("rid", "doc_id", "words").join(runs, "rid", "left")
    hit = hit.select("doc_id", "words", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    more = [("text", pa.string())] if texts else []
    fields = [("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "period", "length")]))), ("collapsed_sha256", pa.string()), *more]

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in columns(parts, "doc_id", "words", "runs"):
            out = []
            for doc_id, line, mine in zip(*some, strict=True):
                left = b" ".join(collapse(line.split(), [(r["start"], r["length"], r["period"]) for r in mine]))
                out.append((doc_id, mine, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if texts else [])))
            yield batch(out, fields)

    rest = found.where("fragments IS NULL").select("doc_id", F.array().cast(_RUNS).alias("runs"), F.col("plain").alias("collapsed_sha256"), *([F.col("words").cast("string").alias("text")] if texts else []))
    return rest.unionByName(hit.mapInArrow(finish, f"doc_id long, runs {_RUNS}, collapsed_sha256 string" + ", text string" * texts))


def best_run(runs: str) -> Column:
    """Of runs in order, the first with the greatest length / period, compared exactly; null if there is none."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,period:long,length:long>"), lambda a, b: F.when(better(a, b), b).otherwise(a))
