"""Exact dedup by deterministic block naming, in DataFrame functions only.

Every text is cut into blocks of a fixed number of characters. The distinct blocks are dealt out by hash, sorted and
numbered, so each block has an integer name and equal names mean equal blocks. Then adjacent names are paired, the distinct
pairs sorted and numbered, and so on, until one name is left for each document. Two documents with the same
number of rounds and the same last name are equal: no hash decides.

Scale: a block's text is shuffled once, after copies are combined. Everything else moves integers. The number of rounds is
the logarithm of the longest text in blocks. Copies are combined before each shuffle (``distinct``), and hot names
meet a table with one row a name, in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import chosen, keyed_rows
from tidemark.names import col
from tidemark.scratch import discard, saved, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 1024
#: Rows of a group that meet its record in one task, how many such parts there are at most, and how many large groups are broadcast at most.
SPREAD, MOST_SALTS, MOST_HOT = 512, 4096, 100_000


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _blocks(norm: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters, in one pass; an empty text is one empty piece."""
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % size), F.lit(0)))


def _name(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """The distinct rows of ``keys``, sorted where they are dealt out to and numbered. Written, so that the numbers stay."""
    return saved(keys.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), label)


def block_names(docs: DataFrame, block: int = BLOCK, written: list[DataFrame] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``rid``, its rounds and name, and the columns ``id`` and ``sha`` given.

    ``docs`` has the columns ``id``, ``sha`` and ``norm``. Rows are told apart by ``rid``, so repeated ids do no harm.
    The tables that the result reads are added to ``written``.
    """
    written = [] if written is None else written
    pieces = docs.select("id", "sha", _blocks(F.col("norm"), block).alias("b")).withColumn("rid", F.monotonically_increasing_id())
    texts = docs.select(F.explode(_blocks(F.col("norm"), block)).alias("block")).withColumn("h", F.xxhash64("block"))

    # Blocks travel once with their text, to be sorted and named; afterwards their 64-bit hash stands for them.
    named = saved(texts.distinct().sortWithinPartitions("block").select("h", F.monotonically_increasing_id().alias("name")), "blocks")
    settle(docs.sparkSession)
    # Different blocks with one hash, in practice none, go by their whole text instead.
    clash = named.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("clash"))
    clash = saved(clash, "clash")
    apart = texts.join(clash.select("h"), "h", "left_semi")
    apart = _name(apart, ["block"], "apart").select("h", F.col("block").alias("t"), (-1 - F.col("name")).alias("name"))
    names = named.join(clash, "h", "left_anti").select("h", F.lit("").alias("t"), "name").unionByName(apart)

    occ = pieces.select("rid", "id", "sha", F.size("b").alias("width"), F.posexplode("b").alias("pos", "block"))
    occ = occ.withColumn("h", F.xxhash64("block")).join(clash, "h", "left")
    first = F.col("pos") == 0
    occ = saved(
        occ.select("rid", "pos", "width", "h", F.when(F.col("clash"), F.col("block")).otherwise("").alias("t"), F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha")),
        "occ",
    )
    written += [named, clash, occ]
    settle(docs.sparkSession)
    row = occ.where("pos = 0").select("rid", "id", "sha")
    widest = occ.agg(F.max("width")).first()[0] or 1
    cur = occ.select("rid", "pos", "width", "h", "t").join(names, ["h", "t"]).select("rid", "pos", "width", "name")

    done, level = [], 0
    while True:
        done.append(cur.where("width = 1").select("rid", F.lit(level).alias("level"), "name"))
        if widest <= 1:
            break
        level, widest = level + 1, (widest + 1) // 2
        pair = cur.where("width > 1").groupBy("rid", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("width") + 1, 1).alias("width"))
        pair = pair.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.struct("name"))).alias("b"))
        # A last piece without a neighbour gets a pair of its own kind: c tells it from every name.
        pair = saved(pair.select("rid", "pos", "width", "a", F.coalesce(F.col("b.name"), F.lit(0)).alias("b"), F.col("b").isNotNull().alias("c")), f"pairs{level}")
        names = _name(pair.select("a", "b", "c"), ["a", "b", "c"], f"names{level}")
        written += [pair, names]
        cur = pair.join(names, ["a", "b", "c"]).select("rid", "pos", "width", "name")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return row.join(out, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256 and rid.

    Of equal texts the row with the largest id stays. Null text counts as empty; a null id is below all others.
    If one id occurs on several rows with equal text, exactly one of them is kept. An empty table gives an empty
    result; columns other than the two named are not looked at, whatever their names.
    """
    base = docs.select(col(id_col).alias("id"), normalised(col(text_col)).alias("norm"))
    base = base.withColumn("sha", F.sha2("norm", 256))
    rows = saved(block_names(base, block=block), "identity")
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("id", "rid")).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    # Written, so that only the rows and a row a group meet in the join; a large group's rows spread over salts.
    salts = F.least(F.ceil(F.col("group_size") / SPREAD), F.lit(MOST_SALTS)).cast("int")
    groups = saved(groups.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), salts.alias("salts")), "groups")
    hot = saved(groups.where("salts > 1 AND salt = 0").select("level", "name", "salts"), "large-groups")
    rows = rows.join(F.broadcast(hot) if hot.count() <= MOST_HOT else hot, ["level", "name"], "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    out = rows.join(groups.drop("salts"), ["level", "name", "salt"], "left")
    own = lambda c, alone: F.when(F.col("best").isNull(), alone).otherwise(c)
    kept = own(F.col("rid") == F.col("best.rid"), F.lit(True))
    return out.select(F.col("id").alias(id_col), own(F.col("best.id"), F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "rid")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns as they were, whatever their names.

    Rows go by the key of their content, so no copy of the table is written; of rows that are equal in all columns and
    stay, one stays. ``docs`` is read three times.
    """
    rows, (a, b) = keyed_rows(docs)
    base = rows.select(F.struct(col(id_col).alias("k"), F.col(a).alias("r1"), F.col(b).alias("r2")).alias("id"), normalised(col(text_col)).alias("norm")).withColumn("sha", F.lit(""))
    written: list[DataFrame] = []
    named = block_names(base, block, written).groupBy("level", "name", "id").agg(F.count("*").alias("c"))
    picks = saved(named.groupBy("level", "name").agg(F.max(F.struct("id", "c")).alias("best")).select("best.id.r1", "best.id.r2", "best.c"), "picks")
    for table in written:
        discard(table)
    settle(docs.sparkSession)
    return chosen(docs, picks)
