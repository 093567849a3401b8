import numpy as np
import pytest

from tidemark.llm import simhash


def planted(rng, n_words, changes):
    """A text and a copy with single words replaced, far enough apart to cost five shingles each."""
    words = [f"w{x}" for x in rng.integers(0, 50_000, n_words)]
    copy = list(words)
    for k in range(changes):
        copy[6 + k * ((n_words - 12) // max(1, changes))] = f"new{rng.integers(1 << 40)}"
    return " ".join(words), " ".join(copy)


def test_near_copies_at_all_similarities(spark):
    rng = np.random.default_rng(3)
    rows, near, far = [], set(), set()
    for pair in range(300):
        a, b = planted(rng, 300, 1 + pair % 12)
        rows += [(2 * pair, a), (2 * pair + 1, b)]
        s = simhash.jaccard(simhash.shingle_set(a, 5), simhash.shingle_set(b, 5))
        (near if s >= 0.8 else far).add(2 * pair + 1)
    rows += [(1000, None), (1001, " "), (1002, "one two"), (1003, "ONE  two"), (1004, "one two three")]
    got = {r[0] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    dropped = {r[0] for r in rows} - got
    assert len(near) > 100 and len(far) > 100
    assert dropped == near | {1001, 1003}


@pytest.mark.parametrize("crowd", [0, 3])
def test_a_crowd_of_copies_that_are_apart(spark, monkeypatch, crowd):
    """Many copies at 0.6 to 0.9 of one text and of each other, some of them linked by chains: links and groups as by all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rng.choice(200, int(rng.integers(2, 12)), replace=False):
            copy[at] = f"n{rng.integers(6)}" if k % 3 else f"own{k}"
        texts.append(" ".join(copy))
    texts += ["", None, "one two", " ".join(base), " ".join(base[:170]), " ".join(base[:159])]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    links = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if simhash.jaccard(sets[a], sets[b]) >= simhash.SIMILAR:
                links += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6))
    assert 20 < links < 5000 and sorted(r["doc_id"] for r in got.collect()) == sorted({find(d) for d in range(len(texts))})


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r["doc_id"]: simhash.shingle_set(r["text"], 5) for r in docs.collect()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and simhash.jaccard(sets[a], sets[b]) >= simhash.SIMILAR:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == sorted({find(d) for d in sets})
