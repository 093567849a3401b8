"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters, each tied to its frequent form.

A word's letters are a multiset: a binary vector with a one for each (letter, occurrence). One inserted, deleted or replaced
letter moves it by a Hamming distance of at most two. The dimensions are dealt to PARTS parts by hash; two differences touch two
parts at most, so two such words agree on at least PARTS - 2 parts. Each choice of so many parts gives an exact signature,
and words of a pair share at least one (Arasu, Ganti and Kaushik 2006). Words made of the same syllables share letters
without being alike (measured: 700 candidates a word), so a signature also holds the length of the pair's shorter word and
one half of the letters in their order: the edit lies in one half and leaves the other as it is, so nothing is lost.
Words that share a signature are verified by their edit distance.

Scale: words are counted in the tasks that read the texts, in tables of bounded size, and summed by Spark. Signatures are
64-bit numbers; what an equal number lets through by chance, the edit distance stops. A signature's words are joined, never
gathered, and Spark splits a skewed one.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batch, columns
from tidemark.names import col
from tidemark.scratch import discard, saved

LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
PARTS, DISTANCE = 4, 2
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
_FULL = (1 << 64) - 1
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)


def tally(text: str | None, doc_id: object, slips: bool, total: Counter) -> None:
    """Adds the words of a text to ``total``, as Latin-1 bytes in lower case; with ``slips`` each 31st by hash lacks a letter."""
    raw = (text or "").encode("latin-1", "replace").lower()  # of bytes, only A-Z are lowered; other letters end a run
    before = zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(_RUN.findall(raw)).items():
        if slips and doc_id is not None:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
            if h % SLIP == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
                if len(word) < LEAST_LETTERS:
                    continue
        total[word] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: bool = False) -> DataFrame:
    """``word, n``: the words of LEAST_LETTERS letters or more that occur LEAST_COUNT times or more over all texts."""
    fields = [("word", pa.string()), ("n", pa.int64())]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for ids, texts in columns(parts, "id", "text"):
            for doc_id, text in zip(ids, texts, strict=True):
                tally(text, doc_id, slips, total)
                if len(total) >= HELD:
                    yield batch([(w.decode("latin-1"), n) for w, n in total.items()], fields)
                    total = Counter()
        yield batch([(w.decode("latin-1"), n) for w, n in total.items()], fields)

    read = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("|".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Signatures:
    """The signatures of words; the numbers of (letter, occurrence) are kept, as there are few."""

    def __init__(self) -> None:
        self.dimensions: dict[tuple[str, int], int] = {}
        self.choices = list(itertools.combinations(range(PARTS), PARTS - DISTANCE))

    def of(self, word: str) -> tuple[list[int], list[int]]:
        """Signatures as the shorter (or equally long) word of a pair, and as the longer one."""
        parts, seen = [0] * PARTS, Counter()
        for c in word:
            key = c, seen[c]
            seen[c] += 1
            number = self.dimensions.get(key)
            if number is None:
                number = self.dimensions[key] = _hash(*key)
            parts[number % PARTS] += number
        picked = [sum((parts[k] + k + 1) * (0x9E3779B97F4A7C15 + 2 * k) for k in chosen) for chosen in self.choices]
        both = []
        for size in (len(word), len(word) - 1):
            half, out = size // 2, []
            if size >= LEAST_LETTERS:
                for side in (_hash("<", size, word[:half]), _hash(">", size, word[half - size :])):
                    out += [((p ^ side) * 0xD6E8FEB86659FD93 + j & _FULL) - (1 << 63) for j, p in enumerate(picked)]
            both.append(out)
        return both[0], both[1]


def signed(words: DataFrame) -> DataFrame:
    """``word, n, as_short, as_long``: the words with their signatures in either role."""
    fields = [("word", pa.string()), ("n", pa.int64()), ("as_short", pa.list_(pa.int64())), ("as_long", pa.list_(pa.int64()))]

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        for some, counts in columns(parts, "word", "n"):
            yield batch([(w, n, *signatures.of(w)) for w, n in zip(some, counts, strict=True)], fields)

    return words.select("word", "n").mapInArrow(sign, "word string, n long, as_short array<long>, as_long array<long>")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: words of ``words(word, n)`` exactly one edit apart, in both directions, once each."""
    rows = signed(words)
    left = rows.select(F.explode("as_short").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select(F.explode(F.concat("as_short", "as_long")).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    longer = F.length("b") - F.length("a")
    shared = (longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))
    pairs = left.join(right, "key").where(shared & (F.levenshtein("a", "b", 1) == 1))
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return pairs.select("a", "a_n", "b", "b_n").distinct().select(F.explode(ways).alias("w")).select("w.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of ``forms(word, form)``, by doubling the reach until nothing moves.

    A form is RATIO times as frequent as its word, so chains are short: with 64-bit counts five rounds see their ends.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words(word, n)``, whose words are distinct.

    The form is the most frequent word one edit away (ties: the smallest by code point) if it is ``ratio`` times as frequent; the root
    follows forms to the last. No words give no rows.
    """
    words = saved(words.select("word", "n"), "words")
    best = F.struct((-F.col("other_n")).alias("rank"), F.col("other"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    told = words.join(near, "word", "left")
    often = -F.col("best.rank") >= F.lit(ratio) * F.col("n")
    told = saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.rank")).alias("form_n")), "near")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: bool = False) -> DataFrame:
    """:func:`variants` of the words of all texts.

    Words are runs of ASCII and Latin-1 letters (U+00C0 to U+00FF), of which only A-Z are lowered. Null and empty texts
    have none; texts and words of any length are read whole; repeated rows count again; an empty table gives no rows.
    Columns other than the two are not read, whatever their names. With ``slips`` one letter of about every 31st distinct word
    of a document is left out, by a hash of id and word; a null id leaves its words alone.
    """
    return variants(word_counts(docs, id_col, text_col, slips))
