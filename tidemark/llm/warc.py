"""WARC records in ZIP packages: written by tasks, read back by directory, index and range.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdx``, a CDXJ index (URL key, time, and a JSON object with digest, offset and length), in its order.
The reader fetches the end of the file, parses the central directory (ZIP64 too), finds where each stored member lies,
reads the index, and from then on reads single records by range. Nothing is extracted.

Scale: equal payloads are found from ids, addresses and digests alone; bodies travel once, to meet what is known about
their digest, in a join that adaptive execution may split, and go from there into packages of bounded size, a manifest
row each. Names are new for every attempt and only packages of the manifest count, so a repeated task does no harm.
What a row becomes follows from its content, so a plan that runs twice decides alike. Index lines are dealt out to
tasks in ranges of one package.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batch, columns
from tidemark.names import col
from tidemark.scratch import filesystem, new_path, saved

LEAST_REVISIT = 1000
PACKAGE_BYTES = 256 << 20
RANGE_RECORDS = 2000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
STAMP = "2020-01-01T00:00:00Z"
#: zlib's window size for gzip members.
GZIP = 31


def clean_url(url: str) -> str:
    """The address without characters that would end a header field or an index column."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def url_key(url: str) -> str:
    """The key that an index is sorted by: the host's labels in reverse, then path and query; other text in lower case."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return url.lower() or "-"
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}".lower()


def record(record_id: str, url: str, page: int | None, digest: str, size: int, payload: bytes | None, original: tuple[str, str, int | None] | None = None) -> bytes:
    """A WARC/1.1 record. A revisit of ``original(record id, url, page)`` keeps the HTTP head, with the length of the whole payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if original else payload)
    head = [f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {STAMP}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Target-URI: {url}"] * bool(url)
    head += [f"X-Page-ID: {page}"] * (page is not None)
    if original:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{original[0]}>", f"WARC-Refers-To-Date: {STAMP}"]
        head += [f"WARC-Refers-To-Target-URI: {original[1]}"] * bool(original[1])
        head += [f"X-Refers-To-Page: {original[2]}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields by lower-case name, the payload length that the HTTP head states, and the payload in the record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
    return fields, size, payload


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """``{name: (offset of its data, length)}`` of the stored members of a ZIP file.

    ``read(offset, length)`` returns bytes. Follows the ZIP64 records where the plain fields are full. Members that
    are compressed or encrypted raise ValueError, as does a file without a directory.
    """
    tail_size = min(size, 65_535 + 22)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = size - tail_size + at - 20
        sign, _, where, _ = struct.unpack("<4sIQI", read(locator, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, out, p = read(offset, length), {}, 0
    for _ in range(count):
        sign, flags, method = directory[p : p + 4], *struct.unpack_from("<HH", directory, p + 8)
        if sign != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, p + 20)
        (local,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            tag, wide = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: only the full fields follow, in this order
                r = q + 4
                for field in ("plain", "packed", "local"):
                    if {"plain": plain, "packed": packed, "local": local}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", extra, r)
                        r += 8
                        plain, packed, local = (value if f == field else old for f, old in (("plain", plain), ("packed", packed), ("local", local)))
            q += 4 + wide
        p += 46 + n_name + n_extra + n_note
        if name.endswith("/"):
            continue
        if method or flags & 1:
            raise ValueError(f"{name} isn't stored plainly")
        sign, ln, le = struct.unpack("<4s22xHH", read(local, 30))
        if sign != b"PK\x03\x04":
            raise ValueError("damaged local header")
        out[name] = (local + 30 + ln + le, plain)
    return out


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` and returns the manifest: path, records.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest id is the response (a null id is below
    all others; of equal ids, that with the largest url; of rows that are equal in all three, one) and the others
    revisit it. Null html is an empty payload. Empty tables give no package. Other columns are not read.
    """
    body = F.encode(F.coalesce(col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(col(id_col).cast("long").alias("id"), col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").alias("n"), F.sha1("body").alias("digest"), F.unhex(F.sha2("body", 256)).alias("key"))
    alike = rows.where(F.col("n") >= least).groupBy("key", "id", "url").agg(F.count("*").alias("c"))
    big = alike.groupBy("key").agg(F.max(F.struct("id", "url", "c")).alias("best"), F.sum("c").alias("rows")).where("rows > 1").drop("rows")
    big = saved(big, "repeats")

    name = lambda i, u: F.md5(F.concat_ws("|", F.hex("key"), F.coalesce(i.cast("string"), F.lit("")), F.coalesce(u, F.lit(""))))
    joined = rows.join(big, "key", "left")
    first = F.col("id").eqNullSafe(F.col("best.id")) & F.col("url").eqNullSafe(F.col("best.url"))
    again = F.col("best").isNotNull() & ~F.col("first")
    shape = ["id", "url", "n", "digest", F.when(~F.col("again"), F.col("body")).alias("body"), "again", name(F.col("id"), F.col("url")).alias("name")]
    shape += [name(F.col("best.id"), F.col("best.url")).alias("to_name"), F.col("best.url").alias("to_url"), F.col("best.id").alias("to_id")]
    joined = joined.withColumn("first", first).withColumn("again", again)
    out = joined
    if not big.where("best.c > 1").isEmpty():  # rows that nothing tells apart: one response and so many revisits
        twin = F.col("first") & (F.col("best.c") > 1)
        out = joined.where(F.coalesce(~twin, F.lit(True)))
        held = joined.where(twin).groupBy("key").agg(*[F.first(n).alias(n) for n in ("id", "url", "body", "n", "digest", "best")])
        held = held.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("best.c"))).alias("i")).withColumn("first", F.lit(True)).withColumn("again", F.col("i") > 1)
        out = out.select(*joined.columns).unionByName(held.select(*joined.columns))
    folder = new_path(pages.sparkSession, "packages")
    filesystem(folder)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, made = None, []
        names = ("id", "url", "n", "digest", "body", "again", "name", "to_name", "to_url", "to_id")
        for some in columns(parts, *names):
            for page, url, size, digest, payload, repeat, own, to_name, to_url, to_id in zip(*some, strict=True):
                if pack is None:
                    pack = _Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                own = uuid.uuid4() if repeat else uuid.UUID(own)
                pack.add(str(own), clean_url(url or ""), page, digest, size, payload, (str(uuid.UUID(to_name)), clean_url(to_url or ""), to_id) if repeat else None)
                if pack.offset >= package_bytes:
                    made.append(pack.close())
                    pack = None
        if pack is not None:
            made.append(pack.close())
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return saved(out.select(*shape).mapInArrow(write, "path string, records long"), "manifest")


class _Package:
    """One ZIP file while it is written: records stream out, an index line for each is kept."""

    def __init__(self, uri: str):
        self.uri, self.index, self.offset = uri, [], 0
        fs, path = filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, record_id: str, url: str, page: int | None, digest: str, size: int, payload: bytes | None, original: tuple | None) -> None:
        raw = zlib.compress(record(record_id, url, page, digest, size, payload, original), 6, GZIP)
        self.data.write(raw)
        fields = {"url": url, "mime": "warc/revisit" if original else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(raw)), "offset": str(self.offset), "filename": DATA.rpartition("/")[2]}
        self.index.append(f"{url_key(url)} {''.join(c for c in STAMP if c.isdigit())} {json.dumps(fields)}")
        self.offset += len(raw)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(sorted(self.index)))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


def index_places(index: str) -> list[tuple[int, int]]:
    """``(offset, length)`` of the records of a CDXJ index, in the order of the data."""
    fields = (json.loads(line[line.index("{") :]) for line in index.split("\n") if line)
    return sorted((int(f["offset"]), int(f["length"])) for f in fields)


def _open(uri: str):
    fs, path = filesystem(uri)
    source = fs.open_input_file(path)
    return source, lambda offset, length: source.read_at(length, offset)


def read_packages(manifest: DataFrame, with_payload: bool = False, range_records: int = RANGE_RECORDS) -> DataFrame:
    """A row for each record of the packages in ``manifest(path)``: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to (and payload, null for revisits). The digest of a response is that of the bytes read."""

    def ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (paths,) in columns(parts, "path"):
            for path in paths:
                source, read = _open(path)
                with source:
                    found = members(read, source.size())
                    base, (at, size) = found[DATA][0], found[INDEX]
                    lines = index_places(read(at, size).decode())
                rows = [(path, base, [o for o, _ in lines[k : k + range_records]], [n for _, n in lines[k : k + range_records]]) for k in range(0, len(lines), range_records)]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "base", "offsets", "sizes"])

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * with_payload

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, bases, offsets, sizes in columns(parts, "path", "base", "offsets", "sizes"):
            for path, base, starts, lengths in zip(paths, bases, offsets, sizes, strict=True):
                source, read = _open(path)
                out: list[tuple] = []
                held = 0
                with source:
                    for start, length in zip(starts, lengths, strict=True):
                        head, size, payload = parse_record(zlib.decompress(read(base + start, length), GZIP))
                        kind = head["warc-type"]
                        stated = head["warc-payload-digest"].removeprefix("sha1:")
                        digest = stated if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"damaged record at {start} of {path}")
                        number = [int(head[n]) if head.get(n, "None") != "None" else None for n in ("x-page-id", "x-refers-to-page")]
                        more = (payload if kind == "response" else None,) if with_payload else ()
                        out.append((number[0], head.get("warc-target-uri"), size, digest, kind, number[1], *more))
                        held += len(payload) if with_payload else 200
                        if held > 8 << 20:
                            yield batch(out, fields)
                            out, held = [], 0
                yield batch(out, fields)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    spans = saved(manifest.select("path").repartition("path").mapInArrow(ranges, "path string, base long, offsets array<long>, sizes array<long>"), "ranges")
    tasks = manifest.sparkSession.sparkContext.defaultParallelism * 4  # small rows that stand for much reading
    return spans.repartition(tasks, "path", "offsets").mapInArrow(fetch, schema)

