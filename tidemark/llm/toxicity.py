"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams; every n-gram has a vector, found by hash. The vectors of a short window
of words are averaged, and a two-class linear softmax reads the average. A document is as toxic as its worst window:
in training the windows of a document share its label through a softmax pool that sharpens from their mean to their
maximum, so a few words in a very long text count as much as in a short one. In the loss a class has the same weight
however rare it is, and that of label 1 MISS_COST times the other's. Vectors and softmax learn together, with Adam. Misspellings and compounds share n-grams, and so
vectors, with the words they come from.

Scale: training takes a bounded sample of labelled rows (``sample_rows`` and ``sample_chars``, whole texts, chosen by
a hash of the id; where too many characters come, the longest texts are passed over). The labels alone say which ids
are in the sample, so the texts are met in the scan by a broadcast of at most ``sample_rows`` ids. One task trains on
them, and the driver gets one number for each n-gram: its vector folded with the softmax, half a megabyte in all.
Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import columns, small_batches
from tidemark.names import all_columns, col, free

BUCKETS, DIM, WINDOW = 1 << 17, 8, 8
GRAMS = range(3, 7)
MOST_LETTERS, PIECE = 64, 32
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 16_000_000
STEPS, RATE, DECAY = 90, 0.05, 1e-6
THRESHOLD = 0.7
#: How much more a toxic document that is missed costs than a clean one that is rejected.
MISS_COST = 2.0
#: Characters read at a time.
SEGMENT = 1 << 18
_SPACE = re.compile(r"\s")
_MARKS = np.zeros(128, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()[]{}<>*_-"]] = True
#: Odd numbers that hash the letters of a word, and of an n-gram by its length.
_ODD = np.random.default_rng(3).integers(0, 1 << 63, (GRAMS[-1] + 1, MOST_LETTERS + 2), np.uint64) * np.uint64(2) + np.uint64(1)


def parts_of(text: str | None) -> Iterator[str]:
    """The text in lower case, in parts of about SEGMENT characters that end at white space.

    Where there is none for as long again, a part ends inside a word and the next begins an n-gram earlier.
    """
    low, i = (text or "").lower(), 0
    while i < len(low):
        j = i + SEGMENT
        space = _SPACE.search(low, j, j + SEGMENT)
        end = min(len(low), space.start() if space else j)
        yield low[i:end]
        i = end if space or end == len(low) else end - GRAMS[-1] + 1


class Words(NamedTuple):
    """The words of some texts, one after the other: the characters of ``<word>``, where each starts, how long it is, and its text."""

    letters: np.ndarray
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray


def words_of(texts: Sequence[str]) -> Words:
    """Words between white space, without punctuation around them, unless they are nothing else.

    A word of over MOST_LETTERS characters, such as a text without white space, is read as pieces of PIECE characters,
    each a word of the window; they overlap, so that no n-gram is lost.
    """
    c = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.concatenate([[True], (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0x85) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x3000), [True]])
    change = np.diff(space.astype(np.int8))
    start, stop = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    marks = (c < 128) & _MARKS[np.minimum(c, 127)]
    s, e = start.copy(), stop.copy()
    for side, step in ((s, 1), (e, -1)):
        live = np.arange(len(s))
        for _ in range(MOST_LETTERS):
            live = live[(s[live] < e[live])]
            live = live[marks[side[live] - (step < 0)]]
            if not len(live):
                break
            side[live] += step
    none = s >= e
    s[none], e[none] = start[none], stop[none]
    over, size = GRAMS[-1] - 1, e - s
    pieces = np.where(size > MOST_LETTERS, -(-(size - over) // (PIECE - over)), 1)
    if (pieces > 1).any():
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        e = np.repeat(e, pieces)
        cut = np.repeat(pieces > 1, pieces)
        s = np.repeat(s, pieces) + number * (PIECE - over)
        e = np.where(cut, np.minimum(e, s + PIECE), e)
        size = e - s
    first = np.cumsum(size + 2) - size - 2
    letters = np.full(int((size + 2).sum()), ord(">"), np.uint64)
    letters[first] = ord("<")
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters[np.repeat(first + 1, size) + inner] = c[np.repeat(s, size) + inner]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Words(letters, first, size + 2, np.searchsorted(ends, s, "right"))


def grams_of(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(word, bucket)`` of all n-grams, for each length in turn, and of the words as a whole."""
    x, word = words.letters, np.repeat(np.arange(len(words.size)), words.size)
    left = words.size[word] - (np.arange(len(x)) - words.first[word])  # letters from here to the end of the word
    for n in GRAMS:
        h = np.zeros(max(0, len(x) - n + 1), np.uint64)
        for k in range(n):
            h += x[k : len(x) - n + 1 + k] * _ODD[n, k]
        at = np.flatnonzero(left[: len(h)] >= n)
        yield word[at], _bucket(h[at])
    yield np.arange(len(words.size)), _bucket(word_hash(words))


def word_hash(words: Words) -> np.ndarray:
    """A 64-bit hash of each whole word."""
    place = np.arange(len(words.letters)) - np.repeat(words.first, words.size)
    return np.add.reduceat((words.letters + np.uint64(1)) * _ODD[0][place], words.first) if len(words.first) else np.zeros(0, np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[1, 0]
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


class Model(NamedTuple):
    """The number of each bucket, the bias, and the score of a text without words: the share of label 1."""

    numbers: np.ndarray
    bias: float
    blank: float


def train(texts: Iterable[str | None], labels: Iterable[int], seed: int = 7, steps: int = STEPS) -> Model:
    """The log-odds of a window are the bias and the mean of its words' numbers.

    Without rows, or with one class only, the bias alone gives the share of label 1 (smoothed).
    """
    parts, truth, seen = [], [], [0, 0]
    for text, label in zip(texts, labels, strict=True):
        seen[label] += 1
        for part in parts_of(text):
            parts.append(part)
            truth.append(sum(seen) - 1 << 1 | label)  # the text's number and its label
    hashes, owner = [], []
    for i, j in _chunks(parts):
        words = words_of(parts[i:j])
        hashes.append(word_hash(words))
        owner.append(np.array(truth[i:j], np.int64)[words.text])
    blank = (seen[1] + 0.5) / (seen[0] + seen[1] + 1)
    owner = np.concatenate([np.zeros(0, np.int64), *owner])
    marks, lengths = np.unique(owner, return_counts=True)  # texts in order, as their numbers rise
    y = (marks & 1).astype(np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), math.log((seen[1] + 0.5) / (seen[0] + 0.5)), blank)
    kinds, place, tokens = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    tokens = tokens.astype(np.int32)
    share = np.where(y == 1, MISS_COST / y.sum(), 1 / (len(y) - y.sum())) / (1 + MISS_COST)
    # The n-grams of each kind of word, from the place where it is first met.
    kind_at, before, grams, of_kind = np.full(len(tokens), -1, np.int32), 0, [], []
    kind_at[place] = np.arange(len(kinds))
    for (i, j), some in zip(_chunks(parts), hashes, strict=True):
        mine = kind_at[before : before + len(some)]
        before += len(some)
        for word, bucket in grams_of(words_of(parts[i:j])):
            new = mine[word] >= 0
            of_kind.append(mine[word[new]])
            grams.append(bucket[new])
    del parts, hashes
    of_kind, grams = np.concatenate(of_kind), np.concatenate(grams)
    order = np.argsort(of_kind, kind="stable")
    grams, sizes = grams[order], np.bincount(of_kind, minlength=len(kinds))
    del of_kind, order
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    ends = np.cumsum(lengths)
    begins, width = ends - lengths, np.minimum(lengths, WINDOW)
    n_windows = lengths - width + 1
    window_first = np.concatenate([[0], np.cumsum(n_windows)[:-1]])
    window_doc = np.repeat(np.arange(len(y), dtype=np.int32), n_windows)
    start = (np.arange(n_windows.sum()) + (begins - window_first)[window_doc]).astype(np.int32)
    wide = width.astype(np.int32)[window_doc]
    stop = start + wide

    rng = np.random.default_rng(seed)
    vectors, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.3, (2, DIM)), np.zeros(2)
    params = [vectors, soft, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    run, change = np.zeros(len(tokens) + 1), np.zeros(len(tokens) + 1)
    for step in range(1, steps + 1):
        axis = soft[1] - soft[0]
        word = np.add.reduceat((vectors @ axis)[grams], first) / sizes
        np.cumsum(word[tokens], out=run[1:])
        z = run[stop]
        z -= run[start]
        z /= wide
        sharp = 0.0 if step <= 8 else min(4.0, 0.25 * (step - 8))
        pull = np.exp(sharp * (z - np.maximum.reduceat(z, window_first)[window_doc]))
        pull /= np.add.reduceat(pull, window_first)[window_doc]
        logit = np.add.reduceat(pull * z, window_first) + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * share
        pull *= error[window_doc]
        pull /= wide
        change[:] = 0.0
        change[start] = pull  # every window has a start and a stop of its own
        change[stop] -= pull
        per_kind = np.bincount(tokens, np.cumsum(change)[: len(tokens)], len(sizes)) / sizes
        per_gram = np.bincount(grams, np.repeat(per_kind, sizes), BUCKETS)
        down = per_gram @ vectors
        grads = [np.outer(per_gram, axis) + DECAY * vectors, np.stack([-down, down]), np.array([-error.sum(), error.sum()])]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model((vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]), blank)


def _chunks(parts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``parts`` with about SEGMENT characters each."""
    i = size = 0
    for k, part in enumerate(parts):
        size += len(part)
        if size >= SEGMENT:
            yield i, k + 1
            i, size = k + 1, 0
    if i < len(parts):
        yield i, len(parts)


def scores(texts: Sequence[str | None], model: Model) -> list[float]:
    """For each text the probability of label 1 for its worst window; that of the sample for a text without words."""
    parts, owner = [], []
    for k, text in enumerate(texts):
        for part in parts_of(text):
            parts.append(part)
            owner.append(k)
    values, texts_of = [np.zeros(0)], [np.zeros(0, np.int64)]
    for i, j in _chunks(parts):
        words = words_of(parts[i:j])
        total, count = np.zeros(len(words.size)), np.zeros(len(words.size))
        for word, bucket in grams_of(words):
            total += np.bincount(word, model.numbers[bucket], len(total))
            count += np.bincount(word, minlength=len(total))
        values.append(total / count)
        texts_of.append(np.array(owner[i:j], np.int64)[words.text])
    run = np.concatenate([[0.0], np.cumsum(np.concatenate(values))])
    ends = np.searchsorted(np.concatenate(texts_of), np.arange(len(texts)), "right")
    out, a = [], 0
    for b in ends.tolist():
        if a == b:
            out.append(model.blank)
            continue
        width = min(b - a, WINDOW)
        z = model.bias + float((run[a + width : b + 1] - run[a : b + 1 - width]).max()) / width
        out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        a = b
    return out


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_chars: int) -> DataFrame:
    """``h, n, text, label`` of a bounded sample of the labelled rows whose crc32(id) mod 3 is not 1.

    The first ``sample_rows`` labelled ids in hash order are the sample. Only if too few of them have a row in ``docs``,
    or a class is missing, ids and lengths (no texts) of all labelled rows are joined and read in hash order.
    """
    hashed = F.xxhash64(F.lit(42), "id").alias("h")
    truth = labels.where(col(label_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col).cast("int")).alias("label"))
    truth = truth.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).select("id", "label", hashed)
    read = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    read = read.select("id", "text", F.length("text").alias("n"), hashed)
    lengths = read.select("id", "n", "h")
    page = truth.orderBy("h", "id").limit(sample_rows)  # bounded, so it may be broadcast
    kept = _picked(lengths.join(F.broadcast(page.select("id", "label")), "id"), sample_rows, sample_chars)
    if 2 * len(kept) < sample_rows or len({r[2] for r in kept}) < 2:
        kept = _picked(lengths.join(truth.select("id", "label"), "id"), sample_rows, sample_chars)
    wanted = docs.sparkSession.createDataFrame(sorted(set(kept)), "h long, n int, label int")
    return read.join(F.broadcast(wanted), ["h", "n"]).select("h", "n", "text", "label")


def _picked(sizes: DataFrame, sample_rows: int, sample_chars: int) -> list[tuple[int, int, int]]:
    """``(h, n, label)`` of the rows of ``sizes(h, n, label)`` to learn from, read a bounded page at a time."""
    kept, seen, last = [], set(), None
    while len(kept) < (sample_rows + 1) // 2:
        page = (sizes if last is None else sizes.where(F.col("h") > last)).select("h", "n", "label").orderBy("h", "n").limit(sample_rows).collect()
        seen |= {r["label"] for r in page}
        kept = _fitting(kept + [tuple(r) for r in page], sample_rows, sample_chars)
        if len(page) < sample_rows:
            break
        last = page[-1]["h"]
    if len({r[2] for r in kept}) < 2:  # a class may be rare or its texts long: its shortest get an eighth of the sample
        other = sizes if not kept else sizes.where(F.col("label") != kept[0][2])
        rare = [tuple(r) for r in other.select("h", "n", "label").orderBy("n", "h").limit(max(1, sample_rows // 8)).collect()]
        seen |= {r[2] for r in rare} | {r[2] for r in kept}
        rare = _fitting(rare, sample_rows, sample_chars // 8) or _fitting(rare[:1], 1, sample_chars)
        kept = rare + _fitting(kept, sample_rows - len(rare), sample_chars - sum(r[1] for r in rare))
        if seen and (not kept or len({r[2] for r in kept}) < len(seen)):
            raise ValueError(f"no labelled text of every class fits in {sample_chars} characters")
    return kept


def _fitting(rows: list[tuple], most_rows: int, most_chars: int) -> list[tuple]:
    """Of ``rows(h, n, label)`` the most that fit: the longest are passed over first, and copies stay together."""
    total, groups = 0, Counter((n, h, label) for h, n, label in rows)
    out = []
    for (n, h, label), count in sorted(groups.items()):
        if total + n * count <= most_chars:
            total += n * count
            out += [(h, n, label)] * count
    return sorted(out)[:most_rows]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS
) -> Model:
    """The model of a sample of at most ``sample_rows`` labelled rows and ``sample_chars`` characters, trained in one task.

    Labels other than 0 and 1 count as 1 if positive, else as 0.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample_rows, sample_chars)
    rows = rows.select("text", (F.col("label") > 0).cast("int").alias("label"), "h", "n").repartition(1).sortWithinPartitions("h", "n", "text").select("text", "label")

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, truth = [], []
        for some, marks in columns(parts, "text", "label"):
            texts += some
            truth += marks
        model = train(texts, truth)
        yield pa.RecordBatch.from_arrays([pa.array([model.numbers.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.blank])], ["numbers", "bias", "blank"])

    model = rows.mapInArrow(learn, "numbers binary, bias double, blank double").first()
    return Model(np.frombuffer(bytes(model[0]), np.float32), model[1], model[2]) if model else train([], [])


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` of doubles in [0, 1].

    Null, empty and wordless texts get the share of label 1 in the sample. Whole texts of any length are read. Repeated rows
    keep their rows; an empty table stays empty. A column that has the new name is replaced.
    """
    small_batches(docs.sparkSession)
    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for (texts,) in columns([pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["t"])], "t"):
                out += scores(texts, model)
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(score_col, of(col(text_col).cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they were, whatever their names."""
    name = free(docs.columns, "__score")
    return with_scores(docs, fit(docs, labels, id_col, text_col, **options), text_col, name).where(F.col(name) < threshold).select(*all_columns(docs))
