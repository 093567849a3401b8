"""Quality scores: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Every text has a few statistics (shares of capitals, marks and digits, repeated words, lengths of words and lines ..),
ratios of counts over the whole text. Small boosted trees are grown on them; every path from a root to a node is a
conjunctive rule, 1 where all of its tests hold. A logistic model with a lasso penalty weighs the rules and leaves most
of them out (Friedman and Popescu 2008). What is left is a sum of CASE expressions that Spark evaluates by itself.

Scale: training takes at most ``sample_rows`` labelled rows (the first of each class in the order of a hash of the id,
weighed so that the classes keep their shares) and needs their statistics only, a dozen numbers each, in one task. Ids of
the sample are broadcast. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.names import all_columns, col, free

SAMPLE_ROWS, THRESHOLD = 20_000, 0.3
TREES, DEPTH, BINS, SHRINK, LEAST_LEAF = 40, 3, 32, 0.2, 20
PENALTY, STEPS = 2e-3, 400
#: Bytes of a text that are counted at a time.
SEGMENT = 1 << 20

STATISTICS = ("words", "word_length", "capitals", "digits", "points", "marks", "marked_words", "mark_words", "capital_words", "repeated", "line_words", "sentence_words")
_COUNTS = ("words", "chars", "lower", "capitals", "digits", "points", "marks", "marked_words", "mark_words", "capital_words", "repeated", "lines", "ends")
_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _MARK, _REST = range(7)


def _classes() -> np.ndarray:
    """What each byte of UTF-8 counts as. Characters beyond ASCII are letters, counted at their first byte."""
    out = np.full(256, _MARK, np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (" \t\n\v\f\r", _SPACE), (".,;:?'\"()-", _POINT)):
        out[[ord(c) for c in chars]] = kind
    out[0x80:0xC0], out[0xC0:] = _REST, _LOWER
    return out


_CLASS = _classes()


def _counted(part: bytes, before: bytes | None) -> tuple[np.ndarray, bytes | None]:
    """Counts over ``part``, which begins and ends at words' ends; ``before`` is the word before it."""
    words = part.split()
    raw = np.frombuffer(part, np.uint8)
    kind = _CLASS[raw]
    sums = np.bincount(kind, minlength=7)
    out = np.zeros(len(_COUNTS))
    out[0], out[1] = len(words), len(raw) - sums[_SPACE] - sums[_REST]
    out[2:7] = sums[_LOWER], sums[_UPPER], sums[_DIGIT], sums[_POINT], sums[_MARK]
    out[11] = np.count_nonzero(raw == 10)
    if not words:
        return out, before
    full = np.concatenate([[False], kind != _SPACE, [False]])
    edge = np.flatnonzero(full[1:] != full[:-1])
    first, last = edge[::2], edge[1::2] - 1
    each = lambda kinds: np.add.reduceat(np.isin(kind, kinds).astype(np.int32), first)
    capitals, letters, symbols = each([_UPPER]), each([_LOWER]), each([_POINT, _MARK])
    out[7] = np.count_nonzero(kind[last] == _MARK)
    out[8] = np.count_nonzero(symbols == last - first + 1)
    out[9] = np.count_nonzero((capitals >= 2) & (letters == 0))
    out[10] = sum(map(eq, words, words[1:])) + (words[0] == before)
    out[12] = np.count_nonzero(np.isin(raw[last], (0x21, 0x2E, 0x3F)))
    return out, words[-1]


def counts(text: str | None) -> np.ndarray:
    """The counts behind the statistics, over the whole text, SEGMENT bytes at a time; null counts as empty."""
    data, total, before, i = (text or "").encode("utf-8", "surrogatepass"), np.zeros(len(_COUNTS)), None, 0
    while i < len(data):
        end = i + SEGMENT
        while end < len(data) and data[end] not in b" \t\n\v\f\r":  # a word is never cut
            end += 1
        some, before = _counted(data[i:end], before)
        total, i = total + some, end
    return total


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text; a text without words has zeros."""
    c = dict(zip(_COUNTS, np.array([counts(t) for t in texts]).reshape(-1, len(_COUNTS)).T, strict=True))
    share = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    words, chars = c["words"], c["chars"]
    # Totals of lines and sentences count one more where the text has words, so that a single line has its length.
    per = lambda n: share(words, n + 1)
    return np.stack([
        words, share(chars, words), share(c["capitals"], c["lower"] + c["capitals"]), share(c["digits"], chars), share(c["points"], chars), share(c["marks"], chars),
        share(c["marked_words"], words), share(c["mark_words"], words), share(c["capital_words"], words), share(c["repeated"], words), per(c["lines"]), per(c["ends"]),
    ], axis=1)


class Rule(NamedTuple):
    """``weight`` is added where every test ``(statistic, above, threshold)`` holds: over the threshold, or at most it."""

    weight: float
    tests: tuple[tuple[str, bool, float], ...]


class Model(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]

    def log_odds(self, row: Column) -> Column:
        """The model as an expression over a struct of statistics."""
        total = F.lit(self.bias)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for name, above, limit in tests:
                holds = holds & ((row[name] > limit) if above else (row[name] <= limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self, row: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(row)))


def _grow(binned: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, path: tuple, found: list, value: np.ndarray) -> None:
    """Splits ``rows`` by the best of all (statistic, bin) by second-order gain; every node under the root gives its path."""
    if path:
        found.append(path)
    g, h = slope[rows], curve[rows]
    leaf = lambda a, b: a * a / (b + 1e-9)
    best, gain = None, 1e-9
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for k in range(binned.shape[1]):
            b = binned[rows, k]
            n, gs, hs = (np.cumsum(np.bincount(b, w, BINS)) for w in (None, g, h))
            ok = (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
            gains = np.where(ok, leaf(gs, hs) + leaf(gs[-1] - gs, hs[-1] - hs) - leaf(gs[-1], hs[-1]), 0)
            at = int(gains.argmax())
            if gains[at] > gain:
                best, gain = (k, at), gains[at]
    if best is None:
        value[rows] = -g.sum() / (h.sum() + 1e-9)
        return
    over = binned[rows, best[0]] > best[1]
    for above, side in ((False, rows[~over]), (True, rows[over])):
        _grow(binned, slope, curve, side, depth - 1, (*path, (best[0], above, best[1])), found, value)


def paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> list[tuple[tuple[str, bool, float], ...]]:
    """The distinct rules of boosted trees on ``x``; each tree sees half of the rows, tests of one kind are merged."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], axis=1)  # bin k: at most cuts[k]
    rng, z, out = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        found, value = [], np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        if len(rows):
            _grow(binned, weight * (p - y), weight * p * (1 - p), rows, DEPTH, (), found, value)
        for path in found:
            tight: dict[tuple[int, bool], int] = {}
            for k, above, at in path:
                tight[k, above] = max(tight.get((k, above), at), at) if above else min(tight.get((k, above), at), at)
            out[tuple((STATISTICS[k], above, float(cuts[k][at])) for (k, above), at in sorted(tight.items()))] = None
        # Rows outside the half move by the mean of those that share their leaf's tests.
        leaves = [q for q in found if not any(len(r) > len(q) and r[: len(q)] == q for r in found)]
        for path in leaves:
            inside = np.ones(len(y), bool)
            for k, above, at in path:
                inside &= (binned[:, k] > at) == above
            mine = value[inside & np.isin(np.arange(len(y)), rows)]
            z[inside] += SHRINK * (np.clip(mine[0], -4, 4) if len(mine) else 0.0)
    return list(out)


def holds(x: np.ndarray, rules: list[tuple[tuple[str, bool, float], ...]]) -> np.ndarray:
    """1 where a row of statistics satisfies a rule."""
    at = {n: k for k, n in enumerate(STATISTICS)}
    out = np.ones((len(x), len(rules)))
    for k, tests in enumerate(rules):
        for name, above, limit in tests:
            out[:, k] *= (x[:, at[name]] > limit) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model with an L1 penalty on standardised columns, by accelerated proximal gradients."""
    mean = weight @ r
    sd = np.sqrt(np.maximum(weight @ (r - mean) ** 2, 1e-12))
    a = (r - mean) / sd
    # The largest eigenvalue bounds the curvature; a few power steps find it.
    v = np.ones(a.shape[1]) / math.sqrt(max(1, a.shape[1]))
    for _ in range(30):
        v = a.T @ (weight * (a @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    top = float(v @ (a.T @ (weight * (a @ v)))) if a.shape[1] else 0.0
    step = 1 / (0.25 * (1.05 * top + 1))
    share = float(weight @ y)
    b, w = math.log(share / (1 - share)), np.zeros(a.shape[1])
    near, old, t = (b, w), (b, w), 1.0
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(near[0] + a @ near[1], -40, 40))) - y)
        b, w = near[0] - step * error.sum(), near[1] - step * (a.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        next_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / next_t
        near, old, t = (b + pull * (b - old[0]), w + pull * (w - old[1])), (b, w), next_t
    return float(b - (w / sd) @ mean), w / sd


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Rules and their weights; with one class only, or no rows, the smoothed share of label 1 and no rules."""
    ones, total = float((weight * y).sum()), float(weight.sum())
    if not 0 < ones < total:
        return Model(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), ())
    weight = weight / total
    rules = paths(x, y, weight * len(y))
    if not rules:
        return Model(math.log(ones / (total - ones)), ())
    r = holds(x, rules)
    _, kinds = np.unique(r, axis=1, return_index=True)  # rules that agree on every row are one
    kinds = np.sort(kinds)
    bias, w = lasso(r[:, kinds], y, weight)
    return Model(bias, tuple(Rule(float(v), rules[k]) for v, k in zip(w, kinds, strict=True) if v != 0.0))


def with_statistics(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct of STATISTICS of the whole text; a column that has the new name is replaced."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(statistics([t if isinstance(t, str) else None for t in part]), columns=list(STATISTICS))

    return docs.withColumn(name, of(col(text_col).cast("string")))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """``label, share, h, <statistics>`` of at most ``sample_rows`` rows; ``share`` is the class's share of the labelled ids.

    Labelled ids whose crc32 mod 5 is 0 are held out. Of each class the first ids in hash order are met by a broadcast; ids
    without a document, or with several, leave the bound as it is. Labels other than 0 and 1 count as 1 if positive, else 0.
    """
    truth = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg((F.max(col(label_col)) > 0).cast("int").alias("label"))
    truth = truth.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).withColumn("h", F.xxhash64(F.lit(11), "id"))
    sizes = {r["label"]: r["count"] for r in truth.groupBy("label").count().collect()}  # two rows at most
    if not sizes:
        return with_statistics(docs.select(col(text_col).alias("text")).limit(0), "s").select(F.lit(0).alias("label"), F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("h"), "s.*")
    each = sample_rows // len(sizes)
    picks = [truth.where(F.col("label") == k).orderBy("h", "id").limit(each) for k in sorted(sizes)]
    wanted = picks[0] if len(picks) == 1 else picks[0].unionByName(picks[1])
    read = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(wanted), "id")
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("label") == k, F.lit(n / sum(sizes.values()))).otherwise(share)
    rows = with_statistics(read.select("text", "label", "h"), "s").select("label", share.alias("share"), "h", "s.*")
    return rows.orderBy("h", *STATISTICS).limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The rules of a bounded sample of labelled rows, found by one task."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample_rows).repartition(1)

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if not held:
            return
        all_rows = pd.concat(held).sort_values(["h", *STATISTICS], kind="stable")  # reruns learn alike
        y = all_rows["label"].to_numpy(np.float64)
        seen = np.where(y == 1, max(1.0, y.sum()), max(1.0, (1 - y).sum()))
        model = train(all_rows[list(STATISTICS)].to_numpy(np.float64), y, all_rows["share"].to_numpy(np.float64) / seen)
        yield pd.DataFrame({"model": [json.dumps(model)]})

    got = rows.mapInPandas(learn, "model string").first()
    if got is None:
        return train(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0))
    bias, rules = json.loads(got[0])
    return Model(bias, tuple(Rule(w, tuple((n, above, t) for n, above, t in tests)) for w, tests in rules))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` of doubles in [0, 1], higher where label 1 is likelier.

    Null, empty and wordless texts have statistics of zero and the score that the rules give those. Whole texts of any
    length are read. Repeated rows keep their rows, equal texts score alike, an empty table stays empty. A column that has
    the new name is replaced.
    """
    name = free([*docs.columns, score_col], "__statistics")
    return with_statistics(docs, name, text_col).withColumn(score_col, model.score(col(name))).drop(name)


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; all columns as they were, whatever their names."""
    name = free(docs.columns, "__score")
    scored = with_scores(docs, fit(docs, labels, id_col, text_col, **options), text_col, name)
    return scored.where(F.col(name) >= threshold).select(*all_columns(docs))
