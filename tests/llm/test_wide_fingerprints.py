from itertools import combinations

import numpy as np

from tidemark.llm import simhash


def bits(words):
    return int.from_bytes(np.asarray(words, np.int64).tobytes(), "little")


def test_pairs_at_the_limit_share_a_segment():
    """SimHash by multi-index hashing brings pairs of Jaccard 0.8, of few shingles too, and few others."""
    rng = np.random.default_rng(2)
    picks, numbers = simhash.wide_segments(5000)
    for size, pairs in ((4, 600), (80, 600), (400, 300)):
        n = next(n for most, n in numbers if size * 5 // 4 <= most)
        missed = by_chance = 0
        for _ in range(pairs):
            b = rng.integers(0, 1 << 64, size * 5 // 4, np.uint64)
            a, c = b[:size], rng.integers(0, 1 << 64, size, np.uint64)
            assert simhash.jaccard(np.sort(a), np.sort(b)) == simhash.SIMILAR
            prints = [simhash.wide_fingerprint(s) for s in (a, b, c)]
            near = [bits(prints[0][:2] ^ p[:2]).bit_count() <= simhash.SLICE_APART for p in prints]
            x, y, z = (np.unpackbits(p.view(np.uint8))[picks[:n]] for p in prints)
            missed += not (near[1] and (x == y).all(axis=1).any())
            by_chance += near[2] and (x == z).all(axis=1).any()
        assert missed <= 1 and by_chance <= (2 if size > 4 else 20)  # few votes are often even, and such bits 0
    one = rng.integers(0, 1 << 64, 1, np.uint64)
    assert (simhash.wide_fingerprint(np.repeat(one, 1000)) == simhash.wide_fingerprint(one)).all()


def test_sets_of_a_key_meet_against_brute_force(spark, monkeypatch):
    """Keys that go on over batches, values of one group, of a large group and few others, and crowds."""
    monkeypatch.setattr(simhash, "MET_ROWS", 7)
    monkeypatch.setattr(simhash, "CROWD", 3)
    rng = np.random.default_rng(4)
    rows, same = [], 0
    for key in range(60):
        for k in range(int(rng.integers(1, 4)) if key % 4 else 40):
            root = {0: 0, 4: 0 if k > 2 else k + 1, 8: k}.get(key % 12, int(rng.integers(3)))
            f, g = (int(x) for x in rng.integers(-1 << 63, 1 << 63, 2)) if rng.integers(5) == 0 else (-1, int(rng.integers(256)))
            rows.append((key, same, root, f, g))
            same += 1
    expected, crowds = set(), set()
    for key in range(60):
        here = [r for r in rows if r[0] == key]
        crowd = len(here) > 3 and len(here) - max(sum(r[2] == s[2] for r in here) for s in here) > 3
        crowds |= {r for r in here if crowd}
        for r, s in combinations(here, 2):
            near = bits((r[3] ^ s[3], r[4] ^ s[4])).bit_count() <= simhash.SLICE_APART
            if near and r[2] != s[2] and (not crowd or r is here[0]):
                expected.add((r[1], s[1], r[2], s[2]))
    got = simhash._met(spark.createDataFrame(rows, "key long, same long, root long, f long, g long")).collect()
    assert {(r.x, r.y, r.a, r.b) for r in got if r.key is None} == expected and len(expected) > 100
    assert {(r.key, r.x, r.a, r.f, r.g) for r in got if r.key is not None} == crowds and len(crowds) == 200
