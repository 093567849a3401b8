from itertools import combinations

import numpy as np

from tidemark.llm import simhash


def test_a_crowd_brings_its_sets_once(spark, monkeypatch):
    """400 copies of one text at about 0.7 of each other, some linked: the rows made grow with the copies, not with the segments that they share; groups as by all pairs."""
    rng = np.random.default_rng(13)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(400):
        if k % 10 == 9:
            texts.append(texts[-1] + " end")
            continue
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

    for a, b in combinations(range(len(sets)), 2):
        if simhash.jaccard(sets[a], sets[b]) >= simhash.SIMILAR:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    made, saved = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, label: (out := saved(df, label), label == "met" and made.append(out.count()))[0])
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6))
    kept = sorted({find(d) for d in range(len(texts))})
    assert 300 < len(kept) <= 360 and sorted(r["doc_id"] for r in got.collect()) == kept
    assert sum(made) <= 10 * len(texts), made


def test_no_pair_is_lost_between_sets_that_were_crowded_before(spark, monkeypatch):
    """Each near pair of a key comes, or both sets have been in a crowd, now or before; no set that was follows again."""
    monkeypatch.setattr(simhash, "CROWD", 3)
    rng = np.random.default_rng(14)
    rows = []
    for key in range(80):
        share = (0, 0.2, 0.9, 1)[key % 4]  # of sets crowded before
        for k in range(int(rng.integers(2, 40))):
            same, group = len(rows), int(rng.integers(1, 12) if rng.integers(3) else 0)
            rows.append((key, same, group, -1, int(rng.integers(256)), 100, *[0] * simhash.ODD_WORDS, bool(rng.random() < share)))
    names = ["key long", "same long", "root long", "f long", "g long", "n long", *[f"o{k} long" for k in range(simhash.ODD_WORDS)], "crowded boolean"]
    got = simhash._met(spark.createDataFrame(rows, ", ".join(names))).collect()
    pairs, new = {(r.x, r.y) for r in got if r.key is None}, {r.x: r for r in got if r.key is not None}
    crowded = {r[1] for r in rows if r[-1]}
    assert pairs and new and not crowded & set(new)
    for key in range(80):
        here = [r for r in rows if r[0] == key]
        for r, s in combinations(here, 2):
            assert r[2] == s[2] or (r[1], s[1]) in pairs or {r[1], s[1]} <= crowded | set(new)
        for r in here:
            if r[1] in new:
                assert (new[r[1]].b is not None) == any(s[-1] for s in here)


def test_prefixes_meet_as_all_pairs_do(spark, monkeypatch):
    """Whatever the sample of counts holds: groups of one and many sets, the largest of which don't ask for each other."""
    rng = np.random.default_rng(15)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"x{rng.integers(3)}" if rng.integers(20) == 0 else w for w in base) for _ in range(70)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    roots = [0 if k < 30 else k for k in range(len(texts))]
    links = {(a, b) for a, b in combinations(range(len(texts)), 2) if roots[a] != roots[b] and simhash.jaccard(sets[a], sets[b]) >= simhash.SIMILAR}
    table = spark.createDataFrame([(k, len(s), roots[k]) for k, s in enumerate(sets)], "same long, n long, root long")
    for share, keys in ((1, 1 << 18), (4, 5), (1 << 30, 10)):
        monkeypatch.setattr(simhash, "ORDER_SHARE", share)
        monkeypatch.setattr(simhash, "ORDER_KEYS", keys)
        prefixes = simhash._prefixes(table, spark.createDataFrame(list(enumerate(texts)), "same long, text string"), 5)
        met = {(r.x, r.y): (r.a, r.b) for r in simhash._meeting(prefixes, simhash.F.lit(True)).collect()}
        assert len(links) > 50 and links <= set(met)
        assert all(x < y and (a, b) == (roots[x], roots[y]) and a != b for (x, y), (a, b) in met.items())
