from datetime import datetime

import pytest

from tidemark.llm import exact_dedup, mixing, rows, simhash

SCHEMA = "doc_id long, text string, lang string, source string, tags array<string>, more array<array<string>>, info struct<t:timestamp,m:map<string,int>>, raw binary"
T = "one two three four five six seven"
AT = datetime(2024, 1, 2, 3, 4, 5, 123)
#: Rows that differ only in where nulls stand, in nesting, in microseconds or in bytes.
ROWS = [
    (1, T, "en", None, None, None, None, None),
    (1, T, None, "en", None, None, None, None),
    (1, T, None, None, [None, "a"], [["a"], ["b"]], None, None),
    (1, T, None, None, ["a", None], [["a", "b"], []], None, None),
    (1, T, None, None, [], None, None, None),
    (1, T, None, None, None, [], None, None),
    (1, T, None, None, None, [None], None, None),
    (1, T, None, None, None, None, (AT, {"a": None}), None),
    (1, T, None, None, None, None, (AT.replace(microsecond=124), {"a": None}), None),
    (1, T, None, None, None, None, (None, None), None),
    (1, T, None, None, None, None, None, b"\xff"),
    (1, T, None, None, None, None, None, b"\xfe"),
    (1, T, "a", "1:b", None, None, None, None),
    (1, T, "a1:", "b", None, None, None, None),
    (None, T, "en", None, None, None, None, None),
    (1, None, T, None, None, None, None, None),
]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_keys_tell_rows_apart(spark):
    keyed, names = rows.keyed_rows(spark.createDataFrame(ROWS + ROWS, SCHEMA))
    got = keyed.select(*names).collect()
    for k in range(2):
        assert len({r[k] for r in got}) == len(ROWS)


def test_mix_takes_each_row_as_often(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[1]], SCHEMA)
    every = docs.collect()
    got = mixing.mix(docs).collect()
    assert {repr(r) for r in got} <= {repr(r) for r in every}
    by_source = {r["source"] for r in every}
    assert {r["source"] for r in got} == by_source
    for source in by_source:  # a source that is taken once or twice over loses no row
        mine, all_of = [repr(r) for r in got if r["source"] == source], [repr(r) for r in every if r["source"] == source]
        if len(mine) >= len(all_of):
            assert set(mine) == set(all_of)


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, simhash.drop_near_copies])
def test_copies_leave_one_row(spark, drop):
    pairs = [(1, None, "abc", None, *[None] * 4), (1, "abc", None, None, *[None] * 4)]
    assert same(drop(spark.createDataFrame(pairs, SCHEMA)).collect(), spark.createDataFrame(pairs, SCHEMA).collect())
    docs = spark.createDataFrame(ROWS + ROWS[:3], SCHEMA)
    got = drop(docs).collect()
    assert len(got) == 2 and {r["text"] for r in got} == {T, None}
    assert all(repr(r) in {repr(x) for x in docs.collect()} for r in got)
