import numpy as np

from tidemark.llm import simhash


def test_copies_of_one_text_that_are_too_far_apart_make_few_candidates(spark, monkeypatch):
    """240 copies at about 0.7 of each other: their pairs share segments, but few are written or verified; links as by all pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(240):
        copy = list(base)
        for at in rng.choice(np.arange(5, 145, 6), 3, replace=False):
            copy[at] = f"own{k}-{at}"
        texts.append(" ".join(copy))
    sets = [simhash.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = 0
    for a in range(1, len(sets)):
        for b in range(a + 1, len(sets)):
            if simhash.jaccard(sets[a], sets[b]) >= simhash.SIMILAR:
                pairs += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    made, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda p, *more: made.append(p.count()) or verified(p, *more))
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts))[1:], "doc_id long, text string").repartition(6))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(d) for d in range(1, len(texts))})
    assert sum(made) <= 4 * pairs + 2 * len(texts), (made, pairs)


def test_pairs_at_the_limit_pass_the_bounds(spark):
    """Sets at exactly SIMILAR always meet, small or large; of sets at 0.6 with few shingles most don't."""
    rng = np.random.default_rng(12)
    rows, limit, below = [], set(), set()
    for k in range(120):
        size = (4, 40, 120, 4000)[k % 4]
        a = rng.integers(0, 1 << 64, size * 5 // 4, np.uint64)
        near, far = a[:size], np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 1 << 64, len(a) // 4, np.uint64)])
        for key, other in ((2 * k, near), (2 * k + 1, far)):
            (limit if other is near else below).add((4 * key, 4 * key + 1))
            rows += [(key, 4 * key + at, 4 * key + at, 0, 0, len(s), *simhash.folded(simhash.odd_bits(s)).tolist()) for at, s in enumerate((a, other))]
    names = ["key", "same", "root", "f", "g", "n", *[f"o{k}" for k in range(simhash.ODD_WORDS)]]
    got = {(r.x, r.y) for r in simhash._met(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))).collect()}
    assert limit <= got and len(got & below) <= 60
