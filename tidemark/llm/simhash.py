"""SimHash near-dedup with multi-index hashing.

Fingerprints: every 64-bit hash of a word shingle votes on each bit. Links: the 64 bits are split into segments, each
with a radius; the radii, each plus one, sum to one more than the bits that a link may have, so of two linked
fingerprints some segment differs in no more bits than its radius. So each fingerprint asks the table of a segment for
all values in the Hamming ball of that radius around its own, and a complete comparison verifies what comes back. How
many segments there are follows from the number of fingerprints: short ones bring chance matches, long ones large
balls, and the shape with the least of both together is taken.

Scale: only distinct fingerprints take part, so a group of exact copies is one row. Dense groups of near copies are
first contracted through links of at most 2 bits, whose balls are small; the second join
returns a link only between groups that are still apart. All joins verify inside the join, so no candidate pairs
are written; adaptive execution may split hot segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import small_batches
from tidemark.llm.components import components
from tidemark.llm.rows import chosen, keyed_rows
from tidemark.names import col
from tidemark.scratch import discard, saved, settle

LINK_BITS, CLOSE_BITS = 4, 2
#: Balls of more than two flipped bits have too many members to ask for.
MOST_RADIUS = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 if it has no word.

    Words are runs without ASCII white space, in lower case for A-Z only; shingles are ``width`` words joined by a
    space, repeats included, or all words of a shorter text. A bit is set if over half of the hashes have it.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):  # a bounded block of bits at a time
        votes += np.unpackbits(hashes[k : k + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(text: Column, width: int) -> Column:
    """A column of signed 64-bit fingerprints."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint(t, width) for t in part], dtype="int64")

    return of(text)


def segments(count: int, bits: int) -> list[tuple[int, int, int]]:
    """``(shift, width, radius)`` of each segment for ``count`` fingerprints and links of ``bits``: the least keys and chance matches."""

    def shape(n: int) -> list[tuple[int, int, int]]:
        widths = [64 // n + (k < 64 % n) for k in range(n)]
        radii = [(bits + 1) // n - 1 + (k < (bits + 1) % n) for k in range(n)]
        return [(64 - sum(widths[: k + 1]), w, r) for k, (w, r) in enumerate(zip(widths, radii, strict=True))]

    count = max(count, 1)

    def cost(parts: list[tuple[int, int, int]]) -> float:
        balls = [(sum(math.comb(w, i) for i in range(r + 1)), w) for _, w, r in parts]
        return sum(count * ball + count * count * ball / 2.0**w for ball, w in balls)

    return min((shape(n) for n in range(1, bits + 2)), key=lambda parts: (cost(parts), len(parts)) if max(r for _, _, r in parts) <= MOST_RADIUS else (math.inf, 0))


def _keys(fps: DataFrame, parts: list[tuple[int, int, int]], balls: bool) -> DataFrame:
    """A row for each segment and, with ``balls``, each value within its radius of the fingerprint's own."""
    out = []
    for k, (shift, width, radius) in enumerate(parts):
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        flips = [sum(1 << i for i in some) for n in range(radius + 1 if balls else 1) for some in combinations(range(width), n)]
        out.append(F.transform(F.array(*[F.lit(x - (x >> 63 << 64)).cast("long") for x in flips]), lambda x: F.struct(F.lit(k).alias("segment"), own.bitwiseXOR(x).alias("value"))))  # noqa: B023
    return fps.withColumn("key", F.explode(F.concat(*out))).select("fp", "root", "key.*")


def _links(fps: DataFrame, bits: int, count: int) -> DataFrame:
    """Pairs of roots whose fingerprints differ in at most ``bits`` bits. ``fps``: fp, root."""
    parts = segments(count, bits)
    a = _keys(fps, parts, True).select("segment", "value", F.col("fp").alias("x"), F.col("root").alias("rx"))
    b = _keys(fps, parts, False).select(F.col("segment").alias("s2"), F.col("value").alias("v2"), F.col("fp").alias("y"), F.col("root").alias("ry"))
    near = (F.col("segment") == F.col("s2")) & (F.col("value") == F.col("v2")) & (F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits)
    return a.join(b.hint("merge"), near).select(F.col("rx").alias("a"), F.col("ry").alias("b"))


def linked(fps: DataFrame) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint; equal roots mean one component under LINK_BITS."""
    fps, count = fps.withColumn("root", F.col("fp")), fps.count()
    near = saved(_rooted(fps, components(_links(fps, CLOSE_BITS, count))), "close")
    return _rooted(near, components(_links(near, LINK_BITS, count)))


def _rooted(fps: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return fps.join(found, "root", "left").select("fp", F.coalesce("new", "root").alias("root"))


def with_components(rows: DataFrame) -> DataFrame:
    """``rows(id, fp, ..)`` with ``component_id``, the smallest id of the row's component (null if none has an id)."""
    fps = saved(rows.groupBy("fp").agg(F.min("id").alias("low")), "fps")
    roots = saved(fps.join(linked(fps.select("fp")), "fp"), "roots")
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(roots.join(lows, "root").select("fp", "component_id"), "fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows and equal ids each
    keep their row. An empty table gives an empty result.
    """
    rows = docs.select(col(id_col).alias("id"), fingerprints(col(text_col), width).alias("fp"))
    out = with_components(saved(rows, "prints"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of the pipeline: Jaccard similarity of the shingle sets; bits of the wide fingerprints that find candidates.
SIMILAR, WIDE_BITS = 0.8, 1024
#: A pair at SIMILAR shares no segment with this probability at most. How often its bits differ there, by the larger set: votes of few shingles are coarse.
MISS, FLIPS = 1e-4, ((5, 0.1875), (64, 0.165), (math.inf, 0.153))
#: The first bits of the wide fingerprints go with each key; a pair at SIMILAR differs in more of them than this with a probability of 3e-7 (5 shingles: 1e-5), two of many shingles at random in no more in 1 of 3,900.
SLICE_APART = 44
#: The segments are met in turns of these shares, so that the next turn finds the groups of the turns before contracted.
TURNS = (1, 3, 6, 6)
_SALT = np.random.default_rng(5).integers(0, 1 << 64, WIDE_BITS // 64, np.uint64)
#: Sets of a segment's value, of other groups than its largest, that all meet its sets; larger crowds meet by their rarest shingles. Bits that bound how far two sets differ.
CROWD, ODD_BITS = 16, 1024
#: Shingles of crowds are put in order by their counts in one of so many sets; so many of these counts at most are kept.
ORDER_SHARE, ORDER_KEYS = 4, 1 << 18
#: Words of odd bits, folded, that go with each key: pairs that these show to be under SIMILAR are no candidates.
ODD_WORDS = 4
#: A task that verifies keeps the sets of the texts it has met, up to so many hashes, then starts anew.
KEPT_HASHES = 1 << 18
#: Rows of keys that a task looks at together.
MET_ROWS = 1 << 15


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of a text (words and shingles as in ``fingerprint``), sorted."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    whole = xxhash.xxh64_intdigest
    return np.unique(np.array([whole(joined[s:e], 42) for s, e in zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles with WIDE_BITS bits: int64 words. A bit is set if over half of the shingles have it."""
    votes = np.zeros(WIDE_BITS, np.int64)
    for k in range(0, len(shingles), 255):  # as many as one byte counts
        x = shingles[k : k + 255, None] + _SALT
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(shingles)).view(np.int64)


def wide_segments(count: int) -> tuple[np.ndarray, list[tuple[float, int]]]:
    """The bits of each segment, a row each, for ``count`` sets, and how many segments sets of up to so many shingles take.

    A segment has bits enough that chance brings about one other set to a value; their number follows from MISS.
    """
    width = max(8, (max(count, 1) - 1).bit_length())
    apart = np.arange(WIDE_BITS + 1)
    ways = np.array([math.lgamma(WIDE_BITS + 1) - math.lgamma(k + 1) - math.lgamma(WIDE_BITS - k + 1) for k in range(WIDE_BITS + 1)])
    numbers = []
    for most, flip in FLIPS:
        odds = np.exp(ways + apart * math.log(flip) + (WIDE_BITS - apart) * math.log(1 - flip))
        other = 1 - (1 - apart / WIDE_BITS) ** width
        n = 1
        while (odds * other**n).sum() > MISS:
            n += 1 + n // 50
        numbers.append((most, n))
    rng = np.random.default_rng(6)
    return np.array([rng.choice(WIDE_BITS, width, replace=False) for _ in range(max(n for _, n in numbers))]), numbers


def _sketches(text: Column, width: int) -> Column:
    """The set's own hash, its size, its wide fingerprint and its odd bits, folded."""

    @F.pandas_udf("same long, n long, wide array<bigint>, odd array<bigint>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t in part:
                s = shingle_set(t, width)
                out.append((xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63), len(s), wide_fingerprint(s), folded(odd_bits(s))))
            yield pd.DataFrame(out, columns=["same", "n", "wide", "odd"])

    return of(text)


def _segment_keys(sets: DataFrame, picks: np.ndarray, numbers: list[tuple[float, int]], first: int, last: int) -> DataFrame:
    """``key, same, root, f, g, n, o0, .., crowded``: a row for each segment from ``first`` up to ``last`` of ``sets(same, n, wide, odd, root, crowded)``, with the segment and its value as key, the first 128 bits, the size and the odd bits."""
    picks, weigh = picks[first:last].astype(np.int16), 1 << np.arange(picks.shape[1], dtype=np.int64)
    table = np.arange(first, first + len(picks), dtype=np.int64) << picks.shape[1]

    @F.pandas_udf("array<bigint>")
    def keys(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for wide, sizes in parts:
            out = []
            for words, n in zip(wide, sizes, strict=True):
                takes = max(0, next(k for most, k in numbers if n <= most) - first) if n / (n + 1) >= SIMILAR else 0  # fewer link to no other set
                bits = np.unpackbits(np.asarray(words, np.int64).view(np.uint8))
                out.append(bits[picks[:takes]] @ weigh + table[:takes])
            yield pd.Series(out, dtype=object)

    made = sets.select("same", "root", F.get("wide", F.lit(0)).alias("f"), F.get("wide", F.lit(1)).alias("g"), *_bounds(), "crowded", keys("wide", "n").alias("keys"))
    return made.select(F.explode("keys").alias("key"), *[c for c in made.columns if c != "keys"])


def _bounds() -> list[Column]:
    """``n, o0, ..`` of sets: what tells :func:`_met` how far apart two of them are at least."""
    return [F.col("n"), *[F.get("odd", F.lit(k)).alias(f"o{k}") for k in range(ODD_WORDS)]]


def _met(rows: DataFrame) -> DataFrame:
    """What the sets of ``rows(key, same, root, f, g, ..)`` that share a key bring: candidate pairs ``x, y, a, b``, with a null key, and new sets of crowds.

    Pairs are of different roots and near by their first bits; with :func:`_bounds` as further columns, pairs whose sizes or odd
    bits rule out SIMILAR don't come, and no link is lost by that. So the copies of one text that are just too far from each
    other to link make few pairs, and a row brings CROWD comparisons at most. A value of at most CROWD sets, or of no more than these outside its
    largest group, brings all its pairs. Any other is a crowd: its sets meet the smallest. With ``crowded`` as last column, sets that have been
    in a crowd before don't meet each other here but at the end, whatever their keys; if at most CROWD others are there, these meet
    all. If more, their rows follow with their key, same as x, root as a, f and g, and as b the root of a set that has been in a crowd before, null if none
    is there. So a set's rows follow in one turn, not in each.
    """
    crowd, n_bounds = CROWD, 1 + ODD_WORDS
    names, schema = rows.columns, "key long, x long, y long, a long, b long, f long, g long"

    def pairs(part: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        _, same, root, f, g, *bounds = part[: 5 + n_bounds]
        differ = [np.bitwise_count((w[i] ^ w[j]).view(np.uint64)) for w in (f, g)]  # of signed numbers it counts the bits of the absolute value
        near = (root[i] != root[j]) & (differ[0] + differ[1] <= SLICE_APART)
        i, j = i[near], j[near]
        if bounds:
            n, *odd = bounds
            apart = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in odd)
            near = (apart <= (n[i] + n[j]) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9) & (np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[near], j[near]
        i, j = np.where(same[i] < same[j], i, j), np.where(same[i] < same[j], j, i)
        return [same[i], same[j], root[i], root[j]]

    def met(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1]]))
        sizes = np.diff(np.append(starts, len(part[0])))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(part[0]))  # rows from here to the end of the key
        before = part[5 + n_bounds] if len(part) > 5 + n_bounds else np.zeros(len(part[0]), bool)
        calm, found, crowds = np.repeat(sizes <= crowd, sizes), [], []
        for d in range(1, int(sizes[sizes <= crowd].max(initial=1))):
            i = np.flatnonzero(calm & (left > d))
            found.append(pairs(part, i, i + d))
        for start, size in zip(starts[sizes > crowd].tolist(), sizes[sizes > crowd].tolist(), strict=True):
            here = np.arange(start, start + size)
            roots, at, counts = np.unique(part[2][here], return_inverse=True, return_counts=True)
            if len(roots) == 1:
                continue
            others, new = here[at != counts.argmax()], here[~before[here]]
            if len(others) > crowd:
                found.append(pairs(part, np.full(size, start + part[1][here].argmin()), here))
            few = min(others, new, key=len)
            if len(few) <= crowd:
                found += [pairs(part, np.full(size, k), here) for k in few.tolist()]
            else:
                crowds.append((new, part[2][here[before[here]][:1]]))
        if found:
            x, y, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(x), pa.array(y), pa.array(a), pa.array(b), none, none], ["key", "x", "y", "a", "b", "f", "g"])
        for new, old in crowds:
            key, same, root, f, g = (pa.array(c[new]) for c in part[:5])
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([key, same, none, root, pa.array(old.repeat(len(new))) if len(old) else none, f, g], ["key", "x", "y", "a", "b", "f", "g"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            n += batch.num_rows
            if n >= MET_ROWS and held[0][0][0] != held[-1][0][-1]:
                part = [np.concatenate(c) for c in zip(*held, strict=True)]
                whole = int(np.searchsorted(part[0], part[0][-1]))  # the last key may go on
                yield from met([c[:whole] for c in part])
                held, n = [[c[whole:].copy() for c in part]], n - whole
        if n:
            yield from met([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(task, schema)


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of the distinct ``pairs(x, y, a, b)`` whose texts ``texts(same, text)`` reach SIMILAR, as links (a, b).

    A text in many pairs is hashed once a task, not once a pair.
    """

    @F.pandas_udf("boolean")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str | None, np.ndarray] = {}
        held = 0

        def set_of(t: str | None) -> np.ndarray:
            nonlocal held
            if t not in known:
                if held > KEPT_HASHES:
                    known.clear()
                    held = 0
                known[t] = shingle_set(t, width)
                held += len(known[t])
            return known[t]

        for left, right in parts:
            yield pd.Series([jaccard(set_of(s), set_of(t)) >= SIMILAR for s, t in zip(left, right, strict=True)], dtype="bool")

    both = pairs.join(texts.select(F.col("same").alias("x"), F.col("text").alias("s")), "x").join(texts.select(F.col("same").alias("y"), F.col("text").alias("t")), "y")
    return both.where(alike("s", "t")).select("a", "b")


def similar(sets: DataFrame, count: int, texts_of: Callable[[DataFrame], DataFrame], width: int) -> DataFrame:
    """``(same, root)`` for ``sets(same, n, wide, odd)``, a row a distinct set, about ``count`` of them: equal roots are one component of links of SIMILAR or more.

    Multi-index hashing of wide fingerprints: sets that share a segment, are near by their first bits and may reach SIMILAR by their
    sizes and odd bits are candidates, and the sets themselves decide. The segments come in turns, and what a turn links is one group in the next. Crowds, such as copies of one text
    that differ from it by just under the limit and from each other by more, would make pairs in the square of their number; the sets of
    those that are still apart after their turn meet each other by :func:`_prefixes` at the end instead, which no link escapes. Only the texts of candidates, for which
    ``texts_of`` is asked, travel and are written.
    """
    spark = sets.sparkSession
    picks, numbers = wide_segments(count)
    ends = [numbers[-1][1] * part // sum(TURNS) for part in accumulate(TURNS[:-1])] + [len(picks)]
    near = saved(sets.select("same", F.col("same").alias("root"), F.lit(False).alias("crowded")), "roots")

    def replaced(tables: list[DataFrame], out: DataFrame) -> DataFrame:
        out = saved(out, "roots")
        for table in tables:
            discard(table)
        settle(spark)
        return out

    def linked_by(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        found = components(_verified(pairs, texts, width))
        return replaced([found, near], _renamed(near, found))

    for first, last in zip([0, *ends], ends, strict=False):
        met = saved(_met(_segment_keys(sets.join(near, "same"), picks, numbers, first, last)), "met")
        settle(spark)
        pairs, rows = met.where("key IS NULL").select("x", "y", "a", "b").distinct(), met.where("key IS NOT NULL")
        if not pairs.isEmpty():
            texts = saved(texts_of(_ids(pairs)).dropDuplicates(["same"]), "texts-of-pairs")
            near = linked_by(pairs, texts)
            discard(texts)
        if not rows.isEmpty():
            near = replaced([near], _with_crowds(near, rows.select("key", F.col("x").alias("same"), "b")))
        discard(met)
    crowded = near.where("crowded").select("same", "root")
    if not crowded.isEmpty():
        texts = saved(texts_of(crowded.select("same")).dropDuplicates(["same"]), "texts-of-crowds")
        prefixes = _prefixes(sets.select("same", "n").join(crowded, "same"), texts, width)
        # Two sets that reach SIMILAR share so many of their shingles; what they share is the first of those and at most what is left of either after it.
        fits = F.least("n", "m") >= F.lit(SIMILAR) * F.greatest("n", "m") - F.lit(1e-9)
        share = (F.col("n") + F.col("m")) * SIMILAR / (1 + SIMILAR) - F.lit(1e-9)
        enough = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= share
        differ = sum((F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("other", F.lit(k)))) for k in range(ODD_BITS // 64)), F.lit(0))
        close = differ <= F.col("n") + F.col("m") - 2 * share
        pairs = saved(_meeting(prefixes, fits & enough & close), "pairs")
        near = linked_by(pairs, texts)
        for table in (prefixes, pairs, texts):
            discard(table)
    settle(spark)
    return near.select("same", "root")


def _with_crowds(near: DataFrame, rows: DataFrame) -> DataFrame:
    """``near(same, root, crowded)`` with those sets of ``rows(key, same, b)`` crowded whose crowd is still of more than one group, counting ``b``, a set that was crowded before."""
    rows = rows.join(near.select("same", "root"), "same")
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("b").alias("b")).where("low < high OR b IS NOT NULL")
    new = rows.join(apart.select("key"), "key", "left_semi").select("same", F.lit(True).alias("new")).distinct()
    return near.join(new, "same", "left").select("same", "root", (F.col("crowded") | F.col("new").isNotNull()).alias("crowded"))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("same")).distinct()


def _meeting(rows: DataFrame, fits: Column) -> DataFrame:
    """``x, y, a, b``: the sets of ``rows(key, same, n, root, at, odd, main)`` that share a key and fit, of different roots, with the roots. The sets of a key's largest group don't ask for each other."""
    left = rows.select("key", F.col("same").alias("x"), "n", F.col("root").alias("a"), F.col("at").alias("i"), "odd", "main")
    right = rows.select("key", F.col("same").alias("y"), F.col("n").alias("m"), F.col("root").alias("b"), F.col("at").alias("j"), F.col("odd").alias("other"), "main")
    once = (F.col("x") < F.col("y")) | (F.col("b") == F.col("main"))
    met = left.where("a <> main").drop("main").join(right, "key").where((F.col("a") != F.col("b")) & once & fits)
    swap = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def _prefixes(sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``key, same, n, root, at, odd, main``: the rarest shingles, and their places, of ``sets(same, n, root)``, as many as two sets that reach SIMILAR can't both lack.

    If each set lists its shingles in one order, such sets share one of the first n - ceil(SIMILAR n) + 1 (Chaudhuri et al.
    2006), so no link is lost, whatever the order is. Here the rarest come first, by how often they occur in one of ORDER_SHARE sets: of these only the
    ORDER_KEYS most frequent are told apart, all others are taken as rare. So the counts, which only save comparisons, stay few, and of all sets only the first shingles
    become rows. Shingles that only one group has meet nothing and have no row; main is the group with most sets of a shingle.
    """

    @F.pandas_udf("keys array<bigint>, odd array<bigint>")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [shingle_set(t, width) for t in part]
            yield pd.DataFrame({"keys": [s.view(np.int64) for s in found], "odd": [odd_bits(s) for s in found]})

    made = saved(sets.join(texts, "same").select("same", "n", "root", shingles("text").alias("s")).select("same", "n", "root", "s.*"), "shingles")
    some = made.where(F.pmod(F.xxhash64("same"), F.lit(ORDER_SHARE)) == 0).select(F.explode("keys").alias("key"))
    often = some.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "key").limit(ORDER_KEYS).toArrow().sort_by("key")
    often, counts = (often[c].to_numpy() for c in ("key", "c"))

    @F.pandas_udf("array<bigint>")
    def first(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for keys in part:
                at = np.searchsorted(often, keys)
                known = at < len(often)
                known[known] = often[at[known]] == keys[known]
                c = np.zeros(len(keys), np.int64)
                c[known] = counts[at[known]]
                out.append(keys[np.lexsort((keys, c))[: len(keys) - math.ceil(SIMILAR * len(keys) - 1e-9) + 1]])
            yield pd.Series(out, dtype=object)

    ranked = saved(made.select("same", "n", "root", F.posexplode(first("keys")).alias("at", "key")).withColumn("at", F.col("at") + 1), "ranked")
    main = ranked.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    rows = saved(ranked.join(main.select("key", "main"), "key").join(made.select("same", "odd"), "same").select("key", "same", "n", "root", "at", "odd", "main"), "prefixes")
    for table in (made, ranked):
        discard(table)
    return rows


def odd_bits(shingles: np.ndarray) -> np.ndarray:
    """ODD_BITS bits, one for each place to which an odd number of the shingles hash. Where two sets differ in d shingles, their bits differ in d places at most."""
    return np.packbits(np.bincount((shingles >> np.uint64(32)).astype(np.int64) % ODD_BITS, minlength=ODD_BITS).astype(np.uint8) & 1).view(np.int64)


def folded(odd: np.ndarray) -> np.ndarray:
    """The odd bits of a set over ODD_WORDS words of places: again one for each place to which an odd number of shingles hash."""
    return np.bitwise_xor.reduce(odd.reshape(-1, ODD_WORDS), axis=0)


def _renamed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("same", F.coalesce("new", "root").alias("root"), "crowded")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the smallest id; all columns as they were.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of SIMILAR or more, and groups are
    the components of these links. At 0.8 fingerprints of 64 bits differ in 10 bits on average, up to 20, and cut into over 20
    segments they select nothing, so fingerprints here have WIDE_BITS bits. Segments of these bring the candidates, and the
    sets themselves decide.
    """
    small_batches(docs.sparkSession)
    rows, (a, b) = keyed_rows(docs)
    mark, text = _sketches(col(text_col), width), col(text_col)
    made = rows.select(col(id_col).alias("k"), F.col(a).alias("r1"), F.col(b).alias("r2"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), mark.alias("s"))
    made = saved(made.select("k", "r1", "r2", "t1", "t2", "s.*"), "sketches")
    key = F.struct(F.col("k").isNull().alias("n"), "k", "r1", "r2")
    lows = saved(made.groupBy("same", key.alias("key")).agg(F.count("*").alias("c")).groupBy("same").agg(F.min(F.struct("key", "c")).alias("low")), "lows")
    sets = saved(made.groupBy("same").agg(F.any_value("n").alias("n"), F.any_value("wide").alias("wide"), F.any_value("odd").alias("odd"), F.min(F.struct("t1", "t2")).alias("t")), "sets")
    known = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.cast("string").alias("text"))
    needed = sets.select("same", "t.t1", "t.t2")
    roots = similar(sets.select("same", "n", "wide", "odd"), docs.count(), lambda ids: known.join(needed.join(ids, "same", "left_semi"), ["t1", "t2"]).select("same", "text"), width)
    picks = lows.join(roots, "same").groupBy("root").agg(F.min("low").alias("low")).select("low.key.r1", "low.key.r2", "low.c")
    picks = saved(picks, "picks")
    for table in (made, lows, sets):
        discard(table)
    settle(docs.sparkSession)
    return chosen(docs, picks)
