"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds consecutive documents in ascending id order: a header, two Elias-Fano sequences (where each document
ends; the document ids), and all token ids as 16-bit integers, one after the other. A sequence of n values up to u
takes about n * (2 + log2(u / n)) bits. ``select(i)`` finds value i from a sample of the positions of ones and a
short scan, so a document's ids are one seek away and no table of 64-bit offsets exists.

Scale: texts are dealt out by range of their id; each task writes files of bounded size as it goes and returns one
row a file, the manifest. Names are new for every attempt and only files of the manifest count, so a lost executor
or a task that ran twice leaves nothing wrong. Places in the whole come from running totals over the manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.batches import batch, columns
from tidemark.llm.tokens import encoder
from tidemark.names import col
from tidemark.scratch import filesystem, new_path, saved

MAGIC = b"TIDETOK1"
HEAD = struct.Struct("<8s6q")  # magic, documents, ids, documents with a null id, smallest id, bytes of either sequence
FILE_IDS = 16 << 20  # ids a file, 32 MB
READ_IDS = 2 << 20  # ids read at a time
READ_DOCS = 4096  # boundaries decoded at a time
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, in near-minimal space, with ``select``."""

    HEAD = struct.Struct("<4q")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4" if n and ones[-1] < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize
        return self.HEAD.pack(self.n, self.low_bits | wide << 8, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, form, low, high = cls.HEAD.unpack_from(data)
        a, b = cls.HEAD.size, cls.HEAD.size + low
        samples = np.frombuffer(data, f"<u{form >> 8}", -(-n // SAMPLE), b + high)
        return cls(n, form & 255, np.frombuffer(data, np.uint8, low, a), np.frombuffer(data, np.uint8, high, b), samples)

    def _low_at(self, i: int) -> int:
        if not self.low_bits:
            return 0
        start = i * self.low_bits
        chunk = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little")
        return chunk >> start % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Value ``i``, from the nearest sampled one and a scan of the bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at // 8, int(self.high[at // 8]) >> at % 8 << at % 8
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low_at(i)

    def span(self, i: int, j: int) -> np.ndarray:
        """Values ``i`` to ``j - 1``: the bits between what ``select`` finds for the two ends, and no others."""
        if j <= i:
            return np.zeros(0, np.int64)
        first, last = ((self.select(k) >> self.low_bits) + k for k in (i, j - 1))
        bits = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits[first % 8 : last - first // 8 * 8 + 1]) + first
        out = (ones - np.arange(i, j)).astype(np.int64) << self.low_bits
        if self.low_bits:
            start = i * self.low_bits
            low = np.unpackbits(self.low[start // 8 : (j * self.low_bits + 7) // 8], bitorder="little")[start % 8 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
            for k in range(self.low_bits):
                out |= low[:, k].astype(np.int64) << k
        return out

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.int64) << k
        return out


def file_bytes(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """Header and both sequences of a file. Null ids come first, then the others in ascending order."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    low = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum(np.array(lengths, np.int64))).to_bytes()
    gaps = known.astype(np.uint64) - np.array(low, np.int64).astype(np.uint64)  # modulo 2**64, right for negative ids too
    ids = EliasFano.encode(gaps).to_bytes()
    return HEAD.pack(MAGIC, len(doc_ids), int(sum(lengths)), len(doc_ids) - len(known), low, len(ends), len(ids)) + ends + ids


class TokenFile:
    """Reads a file by seeking: ``document(i)`` reads one document's ids, ``blocks()`` all of them in bounded parts."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.n, self.n_ids, self.nulls, self.low, a, b = HEAD.unpack(handle.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends = EliasFano.from_bytes(handle.read(a))
        self.gaps = EliasFano.from_bytes(handle.read(b))
        self.data = HEAD.size + a + b

    def _ids(self, start: int, end: int) -> np.ndarray:
        self.handle.seek(self.data + 2 * start)
        return np.frombuffer(self.handle.read(2 * (end - start)), "<u2")

    def document(self, i: int) -> np.ndarray:
        return self._ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def blocks(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, start, ids)`` for each document; boundaries are decoded for a bounded number of documents at a time."""
        for i in range(0, self.n, READ_DOCS):
            j = min(self.n, i + READ_DOCS)
            bounds = np.concatenate([[self.ends.select(i - 1) if i else 0], self.ends.span(i, j)])
            known = self.gaps.span(max(0, i - self.nulls), max(0, j - self.nulls))
            doc_ids = [None] * (j - i - len(known)) + [self.low + int(v) for v in known.view(np.uint64)]
            a = 0
            while a < j - i:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + READ_IDS, "right")) - 1)
                ids = self._ids(int(bounds[a]), int(bounds[b]))
                for k in range(a, b):
                    yield doc_ids[k], int(bounds[k]), ids[bounds[k] - bounds[a] : bounds[k + 1] - bounds[a]]
                a = b


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` and returns the manifest: path, part, number, n_docs, n_ids, first (ids in files before it).

    Ids follow in ascending order over all files; null ids come first; rows with one id are in the order of their
    texts. A null text is empty and gives the end id alone. An id that is no whole number is an error. Extra columns are not read.
    """
    folder = new_path(docs.sparkSession, "token-files")
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text"))  # ascending, nulls first
    rows = rows.sortWithinPartitions("id", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id())

    fields = [("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer).encode, np.array([end_id], "<u2").tobytes()
        ids: list[int | None] = []
        lengths: list[int] = []
        data: list[bytes] = []
        size = number = part = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
            fs, at = filesystem(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(file_bytes(ids, lengths))
                for d in data:
                    out.write(d)
            return batch([(path, part, number, len(ids), size)], fields)

        for rows_in in columns(parts, "id", "text", "part"):
            for doc, text, part in zip(*rows_in, strict=True):
                raw = encode(text) + tail
                ids.append(doc)
                lengths.append(len(raw) // 2)
                data.append(raw)
                size += len(raw) // 2
                if size >= FILE_IDS:
                    yield flush()
                    ids, lengths, data, size, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    made = saved(rows.mapInArrow(write, "path string, part int, number int, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return made.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, of_document: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    """``(doc_id, start, n_tokens, value)`` for every document of the files; ``value`` is what ``of_document`` makes of its ids."""

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("value", kind)]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, firsts in columns(parts, "path", "first"):
            for path, first in zip(paths, firsts, strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as handle:
                    file = TokenFile(handle)
                    for docs in batched(file.blocks(), 4096):
                        yield batch([(doc, first + start, len(ids), of_document(ids)) for doc, start, ids in docs], fields)

    dealt = manifest.select("path", "first").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return dealt.mapInArrow(read, from_arrow_schema(pa.schema(fields)))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
