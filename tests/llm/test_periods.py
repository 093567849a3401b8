import hashlib
import random
import zlib

import pytest

from tidemark.llm import periods, queries

SF = "/root/testdata/sf0.001"


def slow_runs(words):
    """Every run by definition: each stretch of equal words a period apart, the smallest period of each stretch."""
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                out.setdefault((i, length), p)
            i = max(j, i) + 1
    return sorted((s, p, length) for (s, length), p in out.items())


def slow_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, p, length in runs for i in range(s + p, s + length)}
    best = None
    for s, p, length in runs:
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    told = sha("".join(f"{s},{length},{p}\n" for s, p, length in runs))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, told, sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fast_runs(documents):
    """Runs from the fragments of the tiles, stitched in plain Python."""
    out = []
    for found in periods.fragments(documents):
        runs = []
        for p in {f[0] for f in found}:
            reach = None
            for _, i, j in sorted(f for f in found if f[0] == p):
                if reach is not None and i <= reach[1]:
                    reach[1] = max(reach[1], j)
                else:
                    reach = [i, j]
                    runs.append((p, reach))
        out.append(sorted((r[0], p, r[1] - r[0] + p) for p, r in runs if r[1] - r[0] + p >= max(6, 4 * p)))
    return out


def planted(rng):
    """Random words over a small alphabet with repetitions of random periods and exponents in them."""
    words = []
    for _ in range(rng.randint(0, 8)):
        root = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] + (root * 12)[: rng.randint(0, 9 * len(root))]
    return [w.encode() for w in words]


def test_tiles_find_every_run():
    rng = random.Random(5)
    documents = [planted(rng) for _ in range(150)] + [[b"x"] * n for n in range(30)] + [[b"x"] * 1000, [b"a", b"b"] * 333, [b"a", b"a", b"b"] * 257 + [b"z"], []]
    want = [slow_runs(d) for d in documents]
    assert fast_runs(documents) == want and sum(map(len, want)) > 300
    assert [fast_runs([d])[0] for d in documents] == want  # tiles cut elsewhere


def test_z_function():
    assert periods.z_function([1, 2, 1, 1, 2, 1, 2]) == [0, 0, 1, 3, 0, 2, 0] and periods.z_function([]) == []


def row_of(r):
    return tuple(r[n] for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def test_query_is_the_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_periods(spark, SF)
    assert sorted(map(row_of, got.collect())) == sorted((slow_row(*r) for r in docs)) and any(r["n_runs"] for r in got.collect())


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "a " * 6, "a a a a a", "a b " * 4 + "a", "w\x0bw\x0cw w\rw\nw\tw", "\x1c x \x1c x \x1c x \x1c x", "é " * 9 + "e", "a b c d " * 2000 + "tail", "a a a a a a b b b b b b"]
    rows = [(k if k % 3 else None, t, "n", 1) for k, t in enumerate(texts)] + [(1, "", "n", 1), (7, texts[7], "m", 2), (7, texts[7], "m", 2)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, rid string, fragments int").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = queries.op13_periods(spark, path)
    assert sorted(map(row_of, got.collect()), key=repr) == sorted((slow_row(r[0], r[1]) for r in rows), key=repr)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/none/documents.parquet")
    assert queries.op13_periods(spark, f"{path}/none").count() == 0


@pytest.mark.parametrize("tails", [False, True])
def test_texts_come_back(spark, tails):
    docs = spark.createDataFrame([(1, "so so so so so so  it goes"), (2, None), (3, "plain  words")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periods.find_runs(docs, tails=tails, texts=True).collect()}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["collapsed_sha256"] for r in got.values())
    if not tails:
        assert [got[k]["text"] for k in (1, 2, 3)] == ["so it goes", "", "plain words"] and got[1]["runs"][0].asDict() == {"start": 0, "period": 1, "length": 6}
