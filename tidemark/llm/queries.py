"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, html_text, mixing, neighbours, packing, periods, quality, simhash, spelling, substrings, token_files, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic block naming over all documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles, multi-index hashing, links of at most 4 bits, over all documents."""
    return simhash.near_dedup(table(spark, sf_dir, "documents"), width=4)


_POSITION = """CASE slot
    WHEN 0 THEN CASE WHEN {s} * 1.0 <= 0.625 THEN 0.0 + 2.0 * ({s} * 1.0 - 0.0) / (1.5 + sqrt(greatest(2.25 + -2.0 * ({s} * 1.0 - 0.0), 0.0)))
                     ELSE 0.5 + 2.0 * ({s} * 1.0 - 0.625) / (1.0 + sqrt(greatest(1.0 + -2.0 * ({s} * 1.0 - 0.625), 0.0))) END
    WHEN 1 THEN 2.0 * {s} / 2.0
    ELSE CASE WHEN {s} * 1.0 <= 0.3125 THEN 0.0 + 2.0 * ({s} * 1.0 - 0.0) / (0.25 + sqrt(greatest(0.0625 + 3.0 * ({s} * 1.0 - 0.0), 0.0)))
              ELSE 0.5 + 2.0 * ({s} * 1.0 - 0.3125) / (1.0 + sqrt(greatest(1.0 + 3.0 * ({s} * 1.0 - 0.3125), 0.0))) END END"""


@query(
    rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
    w AS (SELECT *, r % 3 AS slot, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM per),
    f AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
          FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, slot, source_size, least(cap::DOUBLE, max((1.5::DOUBLE * all_size - caps) / (all_weight - weights)) OVER () * weight) AS target FROM f),
    x AS (SELECT doc_id, size, source_size, target, slot, floor(target + 0.5)::BIGINT AS demand,
            (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    y AS (SELECT *, least(greatest(demand - before, 0), size) AS firsts, least(greatest(demand - before - source_size, 0), size) AS agains, before / greatest(demand, 1)::DOUBLE AS share FROM x)
    SELECT doc_id, size, source_size, target, firsts + agains AS taken, CASE WHEN firsts > 0 THEN round({_POSITION.format(s="share")}, 6) END AS first_position FROM y
    """
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-varying curriculum over all documents, sources at 3, 1, 2."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    out = mixing.assign(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("positions")[0].alias("first_position"))
    out = out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")  # the training order
    return out.withColumn("first_position", F.round("first_position", 6))


@query()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents with Elias-Fano boundaries, written and read back."""
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_files.read_token_files(manifest, token_files.crc_of, pa.int64()).withColumnRenamed("value", "ids_crc32")


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum bin slack packing of all documents into sequences of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword-bag toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query(
    r"""
    WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS MATERIALIZED (SELECT rid, s, md5(array_to_string(w[s:s + 34], ' ')) AS key FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
    gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS pos FROM win WHERE key IN (SELECT key FROM win GROUP BY key HAVING count(*) > 1)),
    words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
    kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
    """
)
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words or more removed from all documents."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every 50th embedding, by cross-polytope hashing."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) > 1 AND n >= 1000 AS again FROM p)
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to FROM r
    """
)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written into ZIP packages and read back by range."""
    return warc.read_packages(warc.write_packages(table(spark, sf_dir, "pages"))).drop("url")


@query()
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages by minimum-cut labelling."""
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query()
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a sparse ensemble of rules."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.with_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query()
def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of them with a periodic tail."""
    rows = periods.find_runs(table(spark, sf_dir, "documents"), tails=True).withColumn("best", periods.best_run("runs"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")], F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


@query(
    r"""
    WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
    once AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM runs WHERE len(w) >= 7 GROUP BY 1, 2),
    codes AS (SELECT doc_id, w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS bytes FROM once),
    hashed AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda b: b::BIGINT)), lambda c, b: xor(c // 256, (t[xor(c % 256, b) + 1])::BIGINT)), 4294967295) AS h FROM codes, crc),
    slips AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE len(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
    holes AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
    short AS (SELECT DISTINCT h.word AS a, h.n AS a_n, w.word AS b, w.n AS b_n FROM holes h JOIN words w ON h.rest = w.word),
    near AS (SELECT a, a_n, b, b_n FROM short UNION ALL SELECT b, b_n, a, a_n FROM short
             UNION ALL SELECT x.word, x.n, y.word, y.n FROM holes x JOIN holes y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
    best AS (SELECT a AS word, count(*) AS n_near, max(b_n) AS form_n, arg_min(b, (-b_n, b)) AS form FROM near GROUP BY 1),
    told AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS tip, 0 AS k FROM told UNION ALL SELECT c.word, t.form, k + 1 FROM chain c JOIN told t ON c.tip = t.word WHERE t.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, arg_max(tip, k) AS root FROM chain GROUP BY 1) USING (word)
    """
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents, each 31st with a slip."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=True)
