import hashlib
import io
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours, warc


def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(1, "u1", big), (2, None, big), (7, "u 7\n", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", other), (6, "u", other), (6, "u", other), (8, "u", "z" * 3_000_000), (9, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read_packages(warc.write_packages(pages, package_bytes=2000), with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert all(r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest() for r in by[page])
        assert all(bytes(r["payload"]) == raw for r in by[page] if r["record_type"] == "response")
    assert by[7][0]["record_type"] == "response" and by[1][0]["refers_to"] == by[2][0]["refers_to"] == 7
    assert sorted(r["record_type"] for r in by[6]) == ["response", "revisit"] and by[None][0]["refers_to"] == 6
    assert {r["record_type"] for p in (3, 4, 5, 8, 9) for r in by[p]} == {"response"}
    empty = warc.read_packages(warc.write_packages(pages.limit(0)))
    assert empty.count() == 0


def test_warc_index_and_references(spark, tmp_path):
    """Other readers' way in: zipfile, gzip members, the CDXJ order, and WARC-Refers-To that names a record."""
    import gzip
    import json

    body = "z" * 1500
    pages = spark.createDataFrame([(1, "http://b.org/x?y=1", body), (2, "http://a.b.org:8080/", body), (2, "http://a.b.org:8080/", body), (2, "http://a.b.org:8080/", body), (3, None, "short")], "page_id long, url string, html string")
    manifest = warc.write_packages(pages.coalesce(1)).collect()
    ids, refers, kinds = set(), [], []
    for row in manifest:
        with zipfile.ZipFile(row["path"].removeprefix("file://")) as z:
            lines = z.read(warc.INDEX).decode().split("\n")
            assert lines == sorted(lines)
            data = z.read(warc.DATA)
            for line in lines:
                place = json.loads(line[line.index("{") :])
                raw = data[int(place["offset"]) :][: int(place["length"])]
                fields, size, payload = warc.parse_record(gzip.decompress(raw))
                kinds.append((fields["warc-type"], fields.get("x-page-id"), fields.get("x-refers-to-page")))
                ids.add(fields["warc-record-id"])
                refers += [fields["warc-refers-to"]] if fields["warc-type"] == "revisit" else []
                assert place["digest"] == fields["warc-payload-digest"] and (len(payload) == size or not payload)
    assert Counter(kinds) == Counter([("response", "2", None), ("revisit", "2", "2"), ("revisit", "2", "2"), ("revisit", "1", "2"), ("response", "3", None)])
    assert len(ids) == 5 and set(refers) < ids and len(set(refers)) == 1
    assert warc.url_key("http://a.b.org:8080/P?q") == "org,b,a:8080)/p?q" and warc.url_key("") == "-"


def test_warc_query_against_sql_with_planted_repeats(spark, tmp_path):
    import duckdb

    from tidemark.llm.queries import QUERIES, SQL

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000)
    pages.unionByName(more).unionByName(pages.limit(1).selectExpr("500000L AS page_id", "url", "cast(null AS string) AS html")).select(*pages.columns).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = db.execute(SQL["op2_warc"])
    names = [c[0] for c in found.description]
    expected = sorted((tuple(r) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r[n] for n in names) for r in QUERIES["op2_warc"](spark, str(tmp_path)).collect()), key=repr)
    assert got == expected and 10 < sum(r[names.index("record_type")] == "revisit" for r in got) <= more.count()


def as_zip64(data: bytes) -> bytes:
    """The same archive of one member with every field of its directory moved to ZIP64 records."""
    end = data.rfind(b"PK\x05\x06")
    size, offset = struct.unpack_from("<II", data, end + 12)
    entry = bytearray(data[offset : offset + size])
    plain, (n_name,) = struct.unpack_from("<I", entry, 24)[0], struct.unpack_from("<H", entry, 28)
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", entry, 30, 28)
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    entry = entry[: 46 + n_name] + struct.pack("<HHQQQ", 1, 24, plain, plain, 0)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, offset + len(entry), 1)
    return data[:offset] + bytes(entry) + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "hello")
    for data in (out.getvalue(), as_zip64(out.getvalue())):
        at, n = warc.members(lambda o, k, data=data: data[o : o + k], len(data))["a/b.txt"]
        assert data[at : at + n] == b"hello"
    with pytest.raises(ValueError):
        warc.members(lambda o, k: b"x" * k, 30)


def exact(rows, k=5):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, v in good:
        if i % 50 == 0:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in good if j != i)[:k]
            out |= {(i, r + 1, j) for r, (_, j) in enumerate(near)}
    return out


def test_neighbours_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r[0], r[2]) for r in neighbours.search(frame, F.col("vec_id") % 50 == 0).collect()}
    expected = {(q, j) for q, _, j in exact([(r[0], r[1]) for r in frame.select("vec_id", "embedding").collect()])}
    assert len(got & expected) >= 0.9 * len(expected) and len(got) == len(expected)


def test_neighbours_hard_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(k, same) for k in range(100, 160)] + [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (50, [float("nan"), 1.0, 1.0]), (0, [3.0, 2.0, 1.0]), (None, same), (4, [1.0]), (200, [-1.0, 0.0, 0.5]), (5, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, v int")
    got = {(r[0], r[1], r[2]) for r in neighbours.search(frame, F.col("vec_id") % 50 == 0).collect()}
    assert got == exact([r for r in rows if r[0] != 4])
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, same), (7, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in neighbours.search(two, F.col("vec_id") % 50 == 0).collect()] == [7]


def test_neighbours_tiny_huge_and_near_equal(spark):
    """Powers that would leave the range of doubles, and one bucket of very many near-equal vectors."""
    rng = np.random.default_rng(1)
    one = rng.normal(size=16)
    near = one + rng.normal(scale=1e-3, size=(3000, 16))
    far = rng.normal(size=(3000, 16))
    rows = [(k, (x * 10.0 ** (300 if k % 3 else -300)).tolist()) for k, x in enumerate(np.concatenate([near, far]))]
    rows += [(6000, [1e-200] * 16), (6001, [3e200] * 16), (6050, [5e-324] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, tables=6, probes=8).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    x = np.array([np.array(v) / max(map(abs, v)) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6051, 50):
        i = q if q < 6001 else 6002
        near_by = x @ x[i]
        near_by[i] = -9
        best = [rows[j][0] for j in np.argsort(-near_by, kind="stable")[:5]]
        hits += len(set(best) & set(got[q]))
        assert len(got[q]) == 5 and all(abs(s - near_by[v if v <= 6001 else 6002]) < 1e-12 for v, s in got[q].items())
    assert hits >= 0.9 * 5 * 122
    assert {6001, 6050} <= set(got[6000])
