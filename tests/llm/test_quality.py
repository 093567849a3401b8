import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries

SF = "/root/testdata/sf0.1"
TEXTS = ["", None, "   \n ", "The cat sat. It sat, and sat!", "UP UP!! DOWN%%% a1b2 | | x", "É é ñandú.\nÉTÉ été\n\nfin", "a\x0bb\x1cc d \ud800", "x" * 5000, "no no no " * 3000 + "| end"]


def slow(text):
    """The statistics, a character and a word at a time."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return [0.0] * len(quality.STATISTICS)
    n, chars = len(words), [c for w in words for c in w]
    lower, upper, digit, points = set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"), set(".,;:?'\"()-")
    letter = lambda c: c in lower or ord(c) > 127
    mark = lambda c: not (letter(c) or c in upper | digit | points)
    letters = sum(letter(c) or c in upper for c in chars)
    caps = lambda w: sum(c in upper for c in w) >= 2 and not any(map(letter, w))
    return [
        n, len(chars) / n, sum(c in upper for c in chars) / letters if letters else 0.0, sum(c in digit for c in chars) / len(chars), sum(c in points for c in chars) / len(chars), sum(map(mark, chars)) / len(chars),
        sum(mark(w[-1]) for w in words) / n, sum(all(mark(c) or c in points for c in w) for w in words) / n, sum(map(caps, words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        n / (text.count("\n") + 1), n / (sum(w[-1] in ".!?" for w in words) + 1),
    ]


def test_statistics_are_those_of_a_slow_reading(monkeypatch):
    assert quality.statistics(TEXTS) == pytest.approx(np.array([slow(t) for t in TEXTS]))
    monkeypatch.setattr(quality, "SEGMENT", 7)
    assert quality.statistics(TEXTS) == pytest.approx(np.array([slow(t) for t in TEXTS]))
    assert quality.statistics([]).shape == (0, len(quality.STATISTICS))


def test_lasso_is_optimal():
    """At the optimum the gradient is the penalty where a weight is not zero, and at most it elsewhere."""
    rng = np.random.default_rng(1)
    r = (rng.random((400, 12)) < 0.3).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * r[:, 0] + 1.5 * r[:, 1]))).astype(float)
    weight, penalty = np.full(400, 1 / 400), 0.02
    bias, w = quality.lasso(r, y, weight, penalty, 5000)
    sd = np.sqrt(weight @ (r - weight @ r) ** 2)
    error = weight * (1 / (1 + np.exp(-bias - r @ w)) - y)
    slope = (r - weight @ r).T @ error / sd
    assert abs(error.sum()) < 1e-6 and (w == 0).any() and (w != 0).any()
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= penalty + 1e-6).all()


def test_columns_score_as_the_rules_say(spark):
    rng = np.random.default_rng(2)
    x = quality.statistics([t for t in TEXTS for _ in range(40)]) + rng.random((40 * len(TEXTS), len(quality.STATISTICS)))
    y = (x[:, 9] > 0.5).astype(float)
    model = quality.train(x, y, np.full(len(y), 1 / len(y)))
    assert model.rules and all(len({t[:2] for t in r.tests}) == len(r.tests) for r in model.rules)
    rows = [(k, t, 1.5, "s") for k, t in enumerate(TEXTS) if t is None or "\ud800" not in t]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, Score double, __statistics string")
    got = quality.with_scores(docs, model, score_col="new").collect()
    assert len(got) == len(rows) + 1 and got[0].asDict().keys() == {"doc_id", "text", "Score", "__statistics", "new"}
    for row in got:
        s = dict(zip(quality.STATISTICS, quality.statistics([row["text"]])[0], strict=True))
        z = model.bias + sum(w for w, tests in model.rules if all((s[n] > t) == above for n, above, t in tests))
        assert row["new"] == pytest.approx(1 / (1 + math.exp(-z)))
    assert quality.with_scores(docs.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(40)], "doc_id long, text string")
    one = docs.select("doc_id", F.lit(1).alias("quality"))
    model = quality.fit(docs, one)
    assert not model.rules and model.bias > 2
    assert quality.fit(docs, one.limit(0)) == quality.Model(0.0, ()) == quality.fit(docs, one.withColumn("quality", F.lit(None).cast("int")))
    assert quality.drop_poor(docs, one).count() == 40 and quality.drop_poor(docs.limit(0), one).columns == docs.columns


def test_bound_holds_with_repeated_ids(spark):
    docs = spark.range(2000).select((F.col("id") % 200).alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality", 50).collect()
    assert 20 <= len(rows) <= 50 and {r["label"] for r in rows} == {0, 1}


def test_held_out_documents_are_told_apart(spark):
    rows = queries.op11_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good, bad = ([r["score"] for r in held if r["quality"] == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.98
    assert sum(r["predicted"] != r["quality"] for r in held) < 0.02 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
