import hashlib
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import substrings, toxicity

SCHEMA = "doc_id long, text string, rid string, starts int, score string"
DATA = "/root/testdata/sf0.001"


def brute_removed(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((r[0], *b) for r, b in zip(rows, brute_removed([r[1] for r in rows], 35), strict=True))
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs).collect())
    assert got == expected
    assert any(r[2] for r in got)


def test_substrings_hard_cases(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "short", "a " * 36, passage, "x " + passage + " y", passage, "x y " * 50, "é" * 100_000, ("long " * 9 + "end ") * 3000]
    rows = [(k if k != 3 else None, t, "r", 1, "s") for k, t in enumerate(texts)] + [(1, "", "r", 1, "s")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = [(r[0], *b) for r, b in zip(rows, brute_removed([r[1] for r in rows], 35), strict=True)]
    assert Counter(tuple(r) for r in got) == Counter(expected)
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.integers(0, 400), st.integers(0, 400))
def test_cover_aligns_any_two_positions(i, j):
    substrings.check_cover(substrings.COVER, substrings.PERIOD, substrings.WINDOW)
    assert any((i + d) % 21 in substrings.COVER and (j + d) % 21 in substrings.COVER for d in range(21))


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"  # 2,650 labelled rows to learn from; the smaller tables have too few
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.with_scores(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").select("score", "toxic").collect()
    good, bad = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.94  # 0.956 was measured; it is 0.9986 with the 6,000 rows of larger tables
    assert toxicity.scores(["you stuupid idiott"], model) > toxicity.scores(["the of and with"], model)


def test_toxicity_edges(spark):
    model = toxicity.train(["idiot scum", "the of", None, "", "idiot", "of the and"] * 4, [1, 0, 0, 0, 1, 0] * 4)
    rows = [(1, None, "a", 1, "x"), (1, None, "a", 1, "x"), (None, "", "b", 2, "y"), (3, " " * 5, "c", 3, "z"), (4, "the of " * 100_000 + "idiot scum", "d", 4, "w"), (5, "the of " * 100_000, "e", 5, "v")]
    got = toxicity.with_scores(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[4] > by[5]
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(empty, labels).columns == empty.columns
    assert toxicity.drop_toxic(empty, labels).count() == 0
