import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_files
from tidemark.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


def expected_rows(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_query_against_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op4_token_files"](spark, SF).collect()) == sorted(expected_rows(rows))


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    rows = [(7, None), (-3, ""), (5, " \t\n"), (9, "Ünïcode 漢字 \u0130 \U0001f600 ﬁ"), (None, "no id"), (1 << 40, "a\x00b <|endoftext|> c"), (2, "word " * 5000), (3, "x" * 20_000)]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, id string")
    manifest = token_files.write_token_files(frame, tokenizer("word_bpe_49k.json"))
    got = token_files.read_token_files(manifest, token_files.crc_of, pa.int64()).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(expected_rows(rows), key=repr)
    empty = token_files.write_token_files(frame.limit(0), tokenizer("word_bpe_49k.json"))
    assert token_files.read_token_files(empty, token_files.crc_of, pa.int64()).count() == 0
    twice = frame.where("doc_id = 2").unionByName(frame.where("doc_id = 2"))
    assert token_files.read_token_files(token_files.write_token_files(twice, tokenizer("word_bpe_49k.json")), token_files.crc_of, pa.int64()).count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        token_files.write_token_files(frame.selectExpr("'x1' AS doc_id", "text"), tokenizer("word_bpe_49k.json"))


@settings(deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(0, 40), st.data())
def test_select_and_span(gaps, shift, data):
    values = np.cumsum(np.array(gaps, np.int64)) << shift if gaps else np.zeros(0, np.int64)
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    assert code.values().tolist() == values.tolist() and [code.select(i) for i in range(len(values))] == values.tolist()
    i = data.draw(st.integers(0, len(values)))
    j = data.draw(st.integers(i, len(values)))
    assert code.span(i, j).tolist() == values[i:j].tolist()
