"""Substring dedup with difference-cover anchors.

A difference cover modulo a period is a set of residues such that any two positions can be moved by one common shift,
below the period, onto positions with residues in the set. Texts are hashed only at such positions: an anchor is the
hash of the words that follow, as many as still lie inside a window after the largest shift. Two equal windows,
wherever they start, therefore share an anchor at the same shift, so a window without a repeated anchor inside has
no copy. Matches then extend from the repeated anchors: each place that a window can reach from one is hashed over the
whole window, in 96 bits, and the places whose window occurs nowhere else are what the match doesn't reach.

Scale: one aggregate with map-side combining finds the hashes that occur at a single place and, since its minimum and
maximum are then that place, says where. So neither anchors nor windows are written or joined, a passage in a third of
all documents is one row, and no pairs are made. Equal texts are one text, known by 95 bits of its hashes: a copied
document goes whole, and joins meet each text with one row. Texts travel twice, to meet the places of their anchors
and of their windows; shuffle files of a finished step go before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import ROWS, columns
from tidemark.names import col
from tidemark.scratch import saved, settle

WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21.
COVER = (3, 6, 7, 12, 14)


def check_cover(cover: tuple[int, ...], period: int, window: int) -> None:
    """Raises ValueError unless every difference occurs and an anchor of at least one word fits the window."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover")
    if window < period:
        raise ValueError("the window must be at least as long as the period")


def words_of(text: str | None) -> tuple[bytes, list[int], list[int]]:
    """The words joined by one space, in UTF-8, and where each starts and ends there."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only: \x20 \x09-\x0d
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    return b" ".join(words), starts.tolist(), ends.tolist()


def anchor_places(n: int, width: int, cover: tuple[int, ...], period: int) -> np.ndarray:
    """Cover positions at which an anchor of ``width`` words fits into ``n`` words."""
    places = np.arange(max(0, n - width + 1))
    return places[np.isin(places % period, cover)]


def candidate_starts(n: int, anchors: np.ndarray, window: int, width: int) -> np.ndarray:
    """Starts of the windows of ``n`` words that hold one of the ``anchors`` (places in order)."""
    last = max(0, n - window + 1)
    lo, hi = np.maximum(0, anchors + width - window), np.minimum(anchors, last - 1)
    some = lo <= hi
    mark = np.bincount(lo[some], minlength=last + 1) - np.bincount(hi[some] + 1, minlength=last + 1)
    return np.flatnonzero(np.cumsum(mark[:last]) > 0)


def removed_mask(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """True for each word that one of the windows covers."""
    mark = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


def without(places: np.ndarray, numbers: list[int] | None) -> np.ndarray:
    """``places`` without those at the given numbers."""
    return np.delete(places, np.array(numbers or [], np.int64))


def single_places(places: DataFrame, keys: list[str]) -> DataFrame:
    """``(rid, tag, found)``: for each text the positions of ``places(rid, tag, pos, keys)`` whose keys occur at no other place."""
    at = F.shiftleft("tag", 32).bitwiseOR(F.col("pos").cast("long"))
    one = places.groupBy(*keys).agg(F.min("rid").alias("rid"), F.max("rid").alias("rid_to"), F.min(at).alias("at"), F.max(at).alias("at_to")).where("rid = rid_to AND at = at_to")
    pos = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return one.groupBy("rid", F.shiftright("at", 32).alias("tag")).agg(F.collect_list(pos).alias("found"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cover: tuple[int, ...] = COVER, period: int = PERIOD, with_text: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept_sha256 (and ``kept_text``).

    A word goes if a window of ``window`` words around it occurs at any other place, in the same document or another.
    Null and wordless texts have no words and the hash of the empty text. Repeated rows, also with equal ids, count
    as places of their own. An empty table gives an empty result; other columns are not read. ``docs`` is read four
    times, so a plan that costs much or changes between runs is best written first.
    """
    check_cover(cover, period, window)
    width = window - period + 1
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("rid"), F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit(0x7FFFFFFF)).alias("tag"))
    key = ["rid", "tag"]

    def fresh(parts: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
        """Rows whose text is not the one before."""
        last = None
        for some in columns(parts, "rid", "tag", *names):
            for row in zip(*some, strict=True):
                if row[:2] != last:
                    last = row[:2]
                    yield row

    def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batched(fresh(parts, "text"), ROWS):
            rids, tags, hashes = [], [], []
            for rid, tag, text in batch:
                joined, s, e = words_of(text)
                if len(s) >= window:
                    rids.append(rid)
                    tags.append(tag)
                    hashes.append(np.array([digest(joined[s[i] : e[i + width - 1]]) for i in anchor_places(len(s), width, cover, period).tolist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(tags, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["rid", "tag", "h"])

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rid, tag, text, single in fresh(parts, "text", "found"):
            joined, s, e = words_of(text)
            at = candidate_starts(len(s), without(anchor_places(len(s), width, cover, period), single), window, width) if len(s) >= window else []
            for k in range(0, len(at), 65536):  # bounded batches for very long texts
                some = at[k : k + 65536].tolist()
                two = np.frombuffer(b"".join([digest(joined[s[i] : e[i + window - 1]]) for i in some]), "<i4").reshape(-1, 4)
                whole = np.ascontiguousarray(two[:, :2]).view("<i8")[:, 0]
                fixed = [pa.array(np.full(len(some), x, np.int64)) for x in (rid, tag)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(some, pa.int32()), pa.array(whole), pa.array(np.ascontiguousarray(two[:, 2]))], ["rid", "tag", "pos", "h1", "h2"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, ROWS):
                piece = part.slice(k, ROWS)
                counts, gone, hashes, texts = [], [], [], []
                for text, single, odd, copied in zip(*(piece.column(n).to_pylist() for n in ("text", "found", "odd", "copied")), strict=True):
                    joined, s, e = words_of(text)
                    n, drop = len(s), None
                    if n >= window and copied:
                        joined, removed = b"", n
                    elif n >= window:
                        starts = candidate_starts(n, without(anchor_places(n, width, cover, period), single), window, width)
                        drop = removed_mask(n, np.setdiff1d(starts, np.array(odd or [], np.int64), assume_unique=True), window)
                        removed = int(drop.sum())
                        if removed:
                            joined = b" ".join([joined[s[i] : e[i]] for i in np.flatnonzero(~drop).tolist()])
                    else:
                        removed = 0
                    counts.append(n)
                    gone.append(removed)
                    hashes.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode("utf-8", "replace"))
                more = [pa.array(texts, pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes, pa.string()), *more], ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
                )

    made = rows.select(*key, "text").mapInArrow(anchors, "rid long, tag long, h array<long>").select(*key, F.posexplode("h").alias("pos", "h"))
    single = saved(single_places(made, ["h"]), "single-anchors")
    settle(docs.sparkSession)
    near = rows.select(*key, "text").join(single, key, "left").mapInArrow(windows, "rid long, tag long, pos int, h1 long, h2 int")
    odd = saved(single_places(near, ["h1", "h2"]).withColumnRenamed("found", "odd"), "single-windows")
    settle(docs.sparkSession)
    copies = rows.groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("copied"))
    # One narrow row a text, so that texts meet all of it in one join, which can be split where many rows are one text.
    marks = single.unionByName(odd, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True)
    marks = saved(marks.groupBy(*key).agg(*[F.any_value(n, ignoreNulls=True).alias(n) for n in ("found", "odd", "copied")]), "marks")
    settle(docs.sparkSession)
    kind = dict(rows.dtypes)["id"]
    out = rows.join(marks, key, "left").select("id", "text", "found", "odd", "copied")
    out = out.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.withColumnRenamed("id", id_col)
