import random
import re
import zlib
from collections import Counter

from tidemark.llm import queries, spelling


def edits(a, b):
    """Edit distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def slow_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def slow_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def plain(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_no_pair_is_lost(spark):
    """Words over few letters, every edit of some of them, anagrams, and a chain of forms."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(7, 10))): rng.randint(2, 50) for _ in range(300)}
    for w in list(words)[:40]:
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "z" + w[k + 1 :], w[::-1], "q" + w, w + "q"):
            if len(v) >= 7:
                words.setdefault(v, rng.randint(2, 900))
    words |= {"xxxxxxx": 3, "xxxxxxxy": 40, "xxxxxxxyy": 500, "xxxxxxxyyw": 6000, "xxxxxxxyywv": 60000, "tieaaaaaa": 90, "tieaaaaab": 90, "tieaaaaac": 9}
    got = plain(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == slow_variants(words)
    by = {r[0]: r for r in got}
    assert by["xxxxxxx"][1:3] == ("xxxxxxxy", "xxxxxxxyywv") and by["tieaaaaac"][1] == "tieaaaaaa" and sum(r[4] for r in got) > 300


def test_long_words_and_letters_many_times(spark):
    words = {"a" * 3000: 50, "a" * 2999: 5, "a" * 2998 + "b": 2, "ab" * 400: 30, "ab" * 399 + "b": 3}
    assert plain(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == slow_variants(words)


def test_query_over_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    stems = ["therefore", "Éclairs", "STRASSEß", "naïvetés", "because×x", "a" * 40, "małopolska", "\U0001d400letters", "under÷line"]
    rows = [(k if k % 9 else None, " ".join(rng.choice(stems) + rng.choice(["", "s", ".", "\n", "﻿"]) for _ in range(30)), 1, "x") for k in range(60)]
    rows += [(100, None, 2, "y"), (101, "", 2, "y"), (102, "therefore " * 4000, 2, "y"), (102, "therefore " * 4000, 2, "y"), (103, "thereforeSTRASSE", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n int, word string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(spelling, "HELD", 5)
    assert plain(queries.op12_spelling(spark, str(tmp_path))) == slow_variants(slow_words([r[:2] for r in rows]))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_spelling(spark, f"{tmp_path}/none").count() == 0
