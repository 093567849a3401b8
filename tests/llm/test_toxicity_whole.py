import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def test_long_first_document_is_passed_over(spark):
    rows = [(k, "idiot scum" if k % 2 else "the of", k % 2) for k in range(300)]
    ids = spark.range(300).where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).orderBy(F.xxhash64(F.lit(42), "id"))
    first = ids.first()[0]
    rows[first] = (first, "x " * 5000, first % 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    args = (frame.drop("toxic"), frame.drop("text"), "doc_id", "text", "toxic", 200)
    got = toxicity.training_rows(*args, 4000).collect()
    assert len(got) == ids.count() - 1 and {r["label"] for r in got} == {0, 1} and sum(len(r["text"]) for r in got) <= 4000
    with pytest.raises(ValueError):
        toxicity.training_rows(*args, 3)


def test_every_part_of_an_unbroken_text_is_scored():
    model = toxicity.train(["idiot scum", "the of", "idiot", "of the and"] * 6, [1, 0, 1, 0] * 6)
    score = lambda t: toxicity.scores([t], model)[0]
    assert score("theofand" * 100 + "idiotscum" * 8 + "theofand" * 100) > score("theofand" * 200) + 0.1
    word = "".join(chr(0x4E00 + k) for k in range(1000))
    words = toxicity.words_of([word])
    pieces = ["".join(map(chr, words.letters[f + 1 : f + n - 1].tolist())) for f, n in zip(words.first, words.size, strict=True)]
    assert all(any(word[i : i + 6] in p for p in pieces) for i in range(995)) and max(map(len, pieces)) <= 64


def test_texts_score_alike_in_any_company(monkeypatch):
    """Batches and parts of long texts make no difference; a text longer than a part is read to its end."""
    model = toxicity.train(["idiot scum", "the of", "idiot", "of the and"] * 6, [1, 0, 1, 0] * 6)
    texts = ["the of", None, "", "(idiot)!", "--- ---", "the of and " * 4000 + "idiot scum", "of" * 9000 + "idiot" + "of" * 9000, "Ünï \u3000 idiot"]
    alone = [toxicity.scores([t], model)[0] for t in texts]
    assert toxicity.scores(texts, model) == pytest.approx(alone, abs=1e-9)
    monkeypatch.setattr(toxicity, "SEGMENT", 1000)
    assert toxicity.scores(texts, model) == pytest.approx(alone, abs=1e-3)
    assert alone[5] > toxicity.scores(["the of and " * 4000], model)[0] and alone[1] == alone[2] == model.blank


def test_query_columns_and_unspaced_text(spark):
    """held_out and predicted against their definitions, and the scores of the fold never seen."""
    import zlib

    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, t in seen if t], [s for s, t in seen if not t]
    assert sum(g > b for g in good for b in bad) > 0.75 * len(good) * len(bad)


def test_documents_with_few_labels_of_their_own(spark):
    """Most labelled ids have no row here: the sample comes from those that have, and clashing columns stay as they are."""
    docs = spark.createDataFrame([(k, "idiot scum" if k % 2 else "the of", "x", 5.0, "d") for k in range(60)] + [(None, None, "y", 6.0, "e")], "doc_id long, text string, __SCORE string, score double, `a.b` string")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = toxicity.drop_toxic(docs, labels, sample_rows=200)
    assert got.columns == docs.columns
    kept = got.collect()
    assert all(r["__SCORE"] in ("x", "y") and r["score"] in (5.0, 6.0) for r in kept)
    assert {r["text"] for r in kept} == {"the of", None}
