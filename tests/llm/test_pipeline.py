import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, mixing, packing, simhash, toxicity
from tidemark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, name string, rid long, size string, key string, h string"


def hard_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "Same Text here", "a"), (4, "same text HERE", "a"), (4, "same text HERE", "b"), (None, "same text here", "a"), (5, "x " * 60_000, "c"), (6, "É é", None), (7, "é é", "c")]
    return spark.createDataFrame([(*r, "en", "n", 1, "s", "k", "h") for r in rows], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_print(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    prints = {r[0]: brute_print(r[1], 4) for r in rows}
    groups = brute_groups(prints.values())
    lows = {}
    for doc, f in prints.items():
        lows[groups[f]] = min(doc, lows.get(groups[f], doc))
    got = {r[0]: (r[1], r[2]) for r in simhash.near_dedup(docs, width=4).collect()}
    assert got == {doc: (f"{f:016x}", lows[groups[f]]) for doc, f in prints.items()}


def test_exact_dedup_hard_rows(spark):
    for block in (3, 1024):
        got = exact_dedup.exact_dedup(hard_rows(spark), block=block).collect()
        assert len(got) == 9 and sum(r["kept"] for r in got) == 5
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter([(1, 2, 2), (2, 2, 2), (3, 4, 4), (4, 4, 4), (4, 4, 4), (None, 4, 4), (5, 5, 1), (6, 6, 1), (7, 7, 1)])


def check_pieces(pieces, texts, capacity=1024):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"]):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p["length"]
        assert at == len(ids)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_pieces(packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect(), dict(map(tuple, docs.collect())))


def test_packing_hard_rows(spark):
    docs = hard_rows(spark)
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    starts = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert starts == Counter(r["doc_id"] for r in docs.collect())  # equal and null ids are documents of their own
    assert {p["length"] for p in pieces if p["doc_id"] in (1, 2)} == {1}
    one = docs.where("doc_id IN (3, 5, 6, 7)")
    check_pieces(packing.pack(one, tokenizer("byte_bpe_50k.json")).collect(), {r["doc_id"]: r["text"] for r in one.collect()})
    assert packing.pack(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(pieces)


def test_near_dedup_hard_rows(spark):
    docs = hard_rows(spark)
    got = Counter((r[0], r[2]) for r in simhash.near_dedup(docs, width=4).collect())
    prints = [(r["doc_id"], brute_print(r["text"], 4)) for r in docs.collect()]
    groups = brute_groups([f for _, f in prints])
    lows = {}
    for doc, f in prints:
        lows[groups[f]] = min((d for d in (doc, lows.get(groups[f])) if d is not None), default=None)
    assert got == Counter((doc, lows[groups[f]]) for doc, f in prints)
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_segments_find_every_link():
    """Of two fingerprints within the bits, some segment is within its radius, whatever the number of rows."""
    import random

    rng = random.Random(2)
    for count in (10, 10**5, 10**8, 10**12):
        for bits in (2, 4):
            parts = simhash.segments(count, bits)
            assert sum(w for _, w, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) == bits + 1
            for _ in range(300):
                flips = sum(1 << i for i in rng.sample(range(64), bits))
                assert any((flips >> shift & (1 << width) - 1).bit_count() <= radius for shift, width, radius in parts)
    assert len(simhash.segments(10, 4)) > len(simhash.segments(10**12, 4))


NAMES = ["__ROW", "__p", "__size", "__FP", "__SCORE", "__same", "a.b", "__position", "__Text", "rid"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_clashing_names_keep_their_values(spark, stage):
    rows = [(k, f"some words of text number {k} and more of them {k * k}", "s", *[f"{n}{k}" for n in NAMES]) for k in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in NAMES]]))
    got = stage(spark, docs, SF)
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert got.count() == 6
        return
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() > 0


def test_mix_takes_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = mixing.mix(docs).collect()
    assert got and all(r["text"] == texts[r["doc_id"]] for r in got)
    sizes = docs.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    taken, target, largest = Counter(), {}, Counter()
    for r in mixing.assign(sizes, whole=True).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


def test_mixing_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = docs.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    rows = mixing.assign(sizes).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, stage):
    docs = hard_rows(spark)
    assert stage(spark, docs, SF).columns == docs.columns
    stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = [r for r in docs.collect() if toxicity.scores([r["text"]], model)[0] < toxicity.THRESHOLD]
    best = {}
    for r in rows:
        key = low(r["text"])
        if key not in best or best[key]["doc_id"] < r["doc_id"]:
            best[key] = r
    sets = {r["doc_id"]: simhash.shingle_set(r["text"], 5) for r in best.values()}
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
    kept = spark.createDataFrame([r for r in best.values() if find(r["doc_id"]) == r["doc_id"]], docs.schema)
    mixed = mixing.mix(kept).collect()
    pieces = corpus_pipeline.run(spark, SF).collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    expected = Counter((r["doc_id"], len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == expected
    check_pieces(pieces, {})
