"""Tables from files of many formats, chosen by suffix; every reader reads where the tasks run."""

from __future__ import annotations

import codecs
import contextlib
import csv
import io
import sys
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.names import col
from tidemark.scratch import filesystem, saved

#: Lines looked at to find a delimiter, and the delimiters tried.
SNIFF_LINES, DELIMITERS = 20, ",;\t|"


def sniff(lines: list[str]) -> str:
    """The delimiter that splits all the records of the lines into the same number of fields, the most fields first; a comma if none does.

    Quoted cells may go on in the next line; of many lines, the last record may be cut off and doesn't count.
    """
    best, most = ",", 1
    for d in DELIMITERS:
        rows = [row for row in csv.reader([line + "\n" for line in lines], delimiter=d) if any(x.strip() for x in row)]
        widths = {len(row) for row in (rows[:-1] if len(lines) >= SNIFF_LINES and len(rows) > 2 else rows)}
        if len(widths) == 1 and max(widths) > most:
            best, most = d, max(widths)
    return best


def _head(spark: SparkSession, path: str) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]


#: What the bytes 80 to 9F mean in cp1252; five of them have no meaning there and stay as they are.
CP1252 = {k: bytes([k]).decode("cp1252", "ignore") for k in range(0x80, 0xA0)}
#: Texts that mean that a cell is empty.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def western(df: DataFrame) -> DataFrame:
    """Text columns read as ISO-8859-1 with the letters that cp1252 has in place of control characters; column names too."""
    known = {k: v for k, v in CP1252.items() if v}
    source, target = "".join(map(chr, known)), "".join(known.values())
    return df.select(*[(F.translate(col(n), source, target) if t == "string" else col(n)).alias(western_text(n)) for n, t in df.dtypes])


def western_text(text: str) -> str:
    return text.translate({k: v for k, v in CP1252.items() if v})


#: Lines of one record that may lie inside quotes; an open quote that is never closed would take in the rest of its file.
MOST_LINES = 10_000


def _quoting(sep: str) -> tuple[Column, Column]:
    """Whether a quote is open after a line that begins outside of quotes, and after one that begins inside.

    Only a quote at the beginning of a field opens one; others, as in ``5" pipe``, are text.
    """
    s = r"\t" if sep == "\t" else "\\" + sep
    blank = "[ ]*+" if sep == "\t" else r"[ \t]*+"
    inside = '[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:{blank}(?:"{inside}"[^{s}]*+|(?!")[^{s}]*+){s})*+{blank}"{inside}'
    value = F.col("value")
    return value.rlike(f"^{fields}$"), value.rlike(f"^{inside}$") | value.rlike(f'^{inside}"[^{s}]*+{s}{fields}$')


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Text with a header line, plain or gzip; the delimiter is found from the first lines unless given.

    Quotes inside quoted cells are doubled; the texts of NULLS are null. One aggregate over the lines tells whether all are
    UTF-8 and whether a quoted cell goes on in the next line; then records are put together from lines, by many tasks a file.
    A second scan finds the types.
    """
    head = _head(spark, path)
    sep = sep or sniff(head)
    lines = spark.read.text(path)
    bad, broken = lines.agg(F.bool_or(~F.is_valid_utf8("value")), F.bool_or(_quoting(sep)[0])).first()  # one row
    if broken:
        raw = _joined_lines(spark, path, sep, head, not bad)
    else:
        raw = spark.read.options(header=True, sep=sep, encoding="ISO-8859-1" if bad else "UTF-8", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    raw = raw.select(*[F.when(~col(n).isin(*NULLS), col(n)).alias(n) for n in raw.columns])
    return inferred(western(raw) if bad else raw)


def _open_before(rows: DataFrame, group: list[str], order: list[str], flip: str, fixed: str, start: Column) -> DataFrame:
    """``rows`` with ``open``: the state before each row, when every row keeps the state, flips it, or sets it to ``fixed``.

    What a stretch of rows does to the state is again one of these, so ranges are summed up first and combined after.
    """
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__flips", F.coalesce(F.sum(F.col(flip).cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("__last", F.last(F.when(F.col(fixed).isNotNull(), F.struct(F.col(fixed).alias("state"), F.col("__flips").alias("flips"))), ignorenulls=True).over(before))
    odd = (F.col("__flips") - F.coalesce(F.col("__last.flips"), F.lit(0))) % 2 == 1
    return rows.withColumn("open", F.coalesce(F.col("__last.state"), start) != odd).drop("__flips", "__last")


def _joined_lines(spark: SparkSession, path: str, sep: str, head: list[str], utf8: bool) -> DataFrame:
    """Records of text in which cells hold line breaks, as text columns.

    A line leaves the state of quoting as it is, flips it, or sets it. Each range of a file (what one task reads) is
    summed up to one row; these give the state at the beginning of every range, and so of every line. Lines that are whole
    records, nearly all, stay where they are; only pieces of broken records are brought together.
    """
    after, inner = _quoting(sep)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = saved(lines.select("*", after.alias("o"), inner.alias("i")), "lines")
    moves = lines.select("*", (F.col("o") & ~F.col("i")).alias("flip"), F.when(F.col("o") == F.col("i"), F.col("o")).alias("fixed"))
    ranges = moves.groupBy("file", "block").agg(F.sum(F.col("flip").cast("int")).alias("n"), F.max(F.when(F.col("fixed").isNotNull(), F.struct("line", "fixed"))).alias("f"))
    flips = moves.join(ranges.where("f IS NOT NULL"), ["file", "block"]).where(F.col("line") > F.col("f.line")).groupBy("file", "block").agg(F.sum(F.col("flip").cast("int")).alias("later"))
    ranges = ranges.join(flips, ["file", "block"], "left")
    odd = F.coalesce(F.col("later"), F.lit(0)) % 2 == 1
    ranges = ranges.select("file", "block", (F.col("f").isNull() & (F.col("n") % 2 == 1)).alias("flip"), F.when(F.col("f").isNotNull(), F.col("f.fixed") != odd).alias("fixed"))
    starts = _open_before(ranges, ["file"], ["block"], "flip", "fixed", F.lit(False)).select("file", "block", F.col("open").alias("start"))  # a row a range
    rows = _open_before(moves.join(starts, ["file", "block"]), ["file", "block"], ["line"], "flip", "fixed", F.col("start"))
    rows = rows.withColumn("first", (F.col("block") == 0) & (F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) == 1))
    rows = saved(rows.select("file", "block", "line", "value", "open", "first", F.when(F.col("open"), F.col("i")).otherwise(F.col("o")).alias("goes_on")), "records")
    whole = rows.where("NOT open AND NOT goes_on").select("value", "first")
    pieces = rows.where("open OR goes_on")
    here = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("record", F.last(F.when(~F.col("open"), F.col("line")), ignorenulls=True).over(here))
    ends = pieces.groupBy("file", "block").agg(F.max("record").alias("last"))
    begun = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.join(ends.select("file", "block", begun.alias("begun")), ["file", "block"]).withColumn("record", F.coalesce("record", "begun"))
    pieces = saved(pieces.select("file", "record", "block", "line", "value", "first"), "pieces")
    long = pieces.groupBy("file", "record").agg(F.count("*").alias("n")).where(F.col("n") > MOST_LINES).select("file").first()
    if long:
        raise ValueError(f"a quote is not closed within {MOST_LINES} lines: {long[0]}")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n")
    joined = pieces.groupBy("file", "record").agg(text.alias("value"), F.bool_or("first").alias("first")).select("value", "first")
    records = whole.unionByName(joined).where("NOT first AND trim(value) <> ''")
    if not utf8:
        records = records.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
        head = [r[0] for r in spark.read.text(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).limit(SNIFF_LINES).collect()]
    names = unique_names(next(csv.reader([line + "\n" for line in head], delimiter=sep), []))
    return _columns(records.select("value"), names, sep, escape='"')


def unique_names(header: list[str]) -> list[str]:
    """Names of columns from a header: trimmed, ``_c<k>`` where there is none, with a number where one is there already in any case."""
    out: list[str] = []
    for k, name in enumerate(header):
        name, n = name.strip() or f"_c{k}", 0
        made = name
        while made.lower() in {x.lower() for x in out}:
            n += 1
            made = f"{name}.{n}"
        out.append(made)
    return out


def inferred(df: DataFrame) -> DataFrame:
    """Text columns with the first type that all their values have: whole number, number, boolean, time, or text; one pass."""
    if not df.columns:
        return df
    tries = ("bigint", "double", "boolean", "timestamp")
    plain = lambda n, t: F.coalesce(F.bool_and((col(n).try_cast(t).isNotNull() & (F.lit(t != "double") | col(n).rlike(r"^[+-]?(\d|\.\d|Inf)")) & (F.lit(t != "boolean") | F.lower(col(n)).isin("true", "false"))) | col(n).isNull()), F.lit(False))
    whole = lambda n: col(n).try_cast("bigint")
    row = df.agg(*[F.struct(F.count(col(n)).alias("n"), F.min(whole(n)).alias("low"), F.max(whole(n)).alias("high"), *[plain(n, t).alias(t) for t in tries]).alias(f"c{k}") for k, n in enumerate(df.columns)]).first()  # one row

    def of(k: int) -> str | None:
        kind = next((t for t in tries if row[k]["n"] and row[k][t]), None)
        return "int" if kind == "bigint" and -(1 << 31) <= row[k]["low"] and row[k]["high"] < 1 << 31 else kind

    kinds = [of(k) for k in range(len(df.columns))]
    return df.select(*[(col(n).try_cast(t) if t else col(n)).alias(n) for n, t in zip(df.columns, kinds, strict=True)])


def _typed(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns of which every value is a number, as doubles; decided in one aggregate."""
    if not names:
        return df
    ok = df.agg(*[F.coalesce(F.bool_and(F.trim(F.col(f"`{n}`")).try_cast("double").isNotNull() | F.col(f"`{n}`").isNull()) & (F.count(f"`{n}`") > 0), F.lit(False)).alias(f"c{k}") for k, n in enumerate(names)]).first()
    return df.select(*[F.trim(F.col(f"`{n}`")).try_cast("double").alias(n) if n in names and ok[names.index(n)] else F.col(f"`{n}`") for n in df.columns])


def _columns(lines: DataFrame, names: list[str], sep: str, quote: str = '"', escape: str = "\\") -> DataFrame:
    """Records of delimited text as text columns."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    row = F.from_csv("value", schema, {"sep": sep, "quote": quote, "escape": escape, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return lines.select(row.alias("r")).select(*[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)])


@contextlib.contextmanager
def _first_member(row: dict) -> Iterator[Callable[[], IO[bytes]]]:
    """How to open the first file of an archive, as a stream, as often as needed."""
    with contextlib.ExitStack() as stack:
        if row.get("content") is not None:
            source = io.BytesIO(row["content"])
        else:
            system, path = filesystem(row["path"])
            source = stack.enter_context(system.open_input_file(path))
        z = stack.enter_context(zipfile.ZipFile(source))
        members = [m for m in z.infolist() if not m.is_dir()]
        if not members:
            raise ValueError(f"the archive holds no file: {row['path']}")
        yield lambda: z.open(members[0])


def _encoding(stream: IO[bytes]) -> str:
    """UTF-8 if all of the stream is, else Latin-1, whose control characters :func:`western` knows."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while some := stream.read(1 << 20):
            decoder.decode(some)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8-sig"


def zipped(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """The first file inside each ZIP archive as one table; columns by name where headers differ.

    Tasks get paths, open the archives where they are and inflate members as streams; the csv module reads records, so
    quotes, doubled quotes and line breaks in cells count. Delimiter, header and encoding are those of each member; null
    markers and types are as in :func:`delimited`. Where Python has no reader for the file system, Spark reads the archives
    (up to 2 GB each). Records are written once, before their types are found.
    """
    found = spark.read.format("binaryFile").load(path)
    listed = found.select("path")
    n = listed.count()
    first = listed.first()
    try:
        by_path = first is None or filesystem(first[0])[0] is not None
    except (ValueError, OSError, NotImplementedError):
        by_path = False
    archives = (listed if by_path else found.select("path", "content")).repartition(max(1, min(n, 10_000)))
    schema = pa.schema([("path", pa.string()), ("code", pa.string()), ("sep", pa.string()), ("names", pa.list_(pa.string()))])

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                with _first_member(row) as member:
                    with member() as f:
                        code = _encoding(f)
                    with member() as f:
                        lines = io.TextIOWrapper(f, code)
                        head = [x for x in (lines.readline(1 << 20) for _ in range(SNIFF_LINES)) if x]
                by = sep or sniff([x.rstrip("\r\n") for x in head])
                names = [western_text(x) if code == "latin-1" else x for x in next(csv.reader(head, delimiter=by), [])]
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "code": code, "sep": by, "names": unique_names(names)}], schema)

    about = saved(archives.mapInArrow(look, "path string, code string, sep string, names array<string>"), "archives")  # a row an archive
    headers = about.groupBy("names").agg(F.min("path").alias("path")).orderBy("path").select("names").collect()  # a row a kind of header
    names = list(dict.fromkeys(x for (header,) in headers for x in header))
    if not names:
        return spark.range(0).select()
    at = {x: k for k, x in enumerate(names)}
    out = pa.schema([("cells", pa.list_(pa.string()))])

    def records(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for part in parts:
            for row in part.to_pylist():
                places, fix = [at[x] for x in row["names"]], row["code"] == "latin-1"
                with _first_member(row) as member, member() as f:
                    held = []
                    reader = csv.reader(io.TextIOWrapper(f, row["code"], newline=""), delimiter=row["sep"])
                    for number, record in enumerate(reader):
                        if not number or not any(x.strip() for x in record):
                            continue
                        cells: list[str | None] = [None] * len(names)
                        for k, x in zip(places, record, strict=False):
                            x = x.strip(" \t")
                            cells[k] = None if x in NULLS else western_text(x) if fix else x
                        held.append(cells)
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], schema=out)
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], schema=out)

    work = about if by_path else about.join(found.select("path", "content"), "path")
    rows = saved(work.repartition(max(1, min(n, 10_000))).mapInArrow(records, "cells array<string>"), "zipped")
    return inferred(rows.select(*[F.get("cells", F.lit(k)).alias(x) for k, x in enumerate(names)]))


def json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one document (an array of objects, or an object of columns: ``{"a": [..], "b": [..]}``).

    One aggregate over all lines decides: they are records if most of them are whole objects. A line that is none then
    gives a row of nulls, with its text in the column ``_corrupt_record``; so does a document that can't be read.
    """
    value = F.trim("value")
    whole = value.startswith("{") & value.endswith("}") & F.try_parse_json(value).isNotNull()
    lines = spark.read.text(path).where("trim(value) <> ''")
    n, objects = lines.agg(F.count("*"), F.count_if(whole)).first()  # one row
    if n > 1 and 2 * objects > n:
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    arrays = [n for n, t in df.dtypes if t.startswith("array")]
    if arrays and len(arrays) == len(df.columns) and "".join(_head(spark, path)).lstrip().startswith("{"):
        return df.select(F.explode(F.arrays_zip(*map(col, arrays))).alias("r")).select("r.*")
    return df


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF: names from the attribute lines of the header, data rows as delimited text; without attributes, delimited text."""
    lines = spark.read.text(path).withColumn("at", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")))
    clean = lines.withColumn("value", F.trim("value")).where("value <> '' AND NOT startswith(value, '%')")
    # Rows begin after the line @data of their file; a row may begin with @ itself.
    begin = clean.where(F.lower("value") == "@data").groupBy(F.col("at.file").alias("file")).agg(F.min("at").alias("begin"))  # a row a file
    body = clean.withColumn("file", F.col("at.file")).join(F.broadcast(begin), "file").where("at > begin")
    header = clean.withColumn("file", F.col("at.file")).join(F.broadcast(begin), "file", "left").where("begin IS NULL OR at < begin").where(F.col("value").rlike(r"(?i)^@attribute\s")).orderBy("at").select("value").collect()  # a line an attribute
    names = []
    for (line,) in header:
        parts = next(csv.reader([line.replace("\t", " ").replace("'", '"')], delimiter=" ", skipinitialspace=True))
        if len(parts) >= 3:
            names.append(parts[1])
    names = list(dict.fromkeys(names))  # files of one folder have the same header each
    if not names:
        return delimited(spark, path)
    return _typed(_columns(body.select("value"), names, ",", "'" if any("'" in h[0] for h in header) else '"'), names)


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``label i:v i:v ..`` lines as columns ``Sensor_<i>``; the label goes, missing entries are null. Other text: white space delimited."""
    tokens = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))
    entry = F.filter(F.slice("t", 2, 1 << 30), lambda x: x.rlike(r"^\d+:\S+$"))
    rows = tokens.select(F.transform(entry, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("k"), F.split(x, ":")[1].try_cast("double").alias("v"))).alias("e")).where(F.size("e") > 0)
    keys = [r[0] for r in rows.select(F.explode("e.k").alias("k")).distinct().orderBy("k").collect()]  # a row a column
    if not keys:
        return spaced(spark, path)
    last = lambda k: F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.transform(F.filter("e", lambda x: x["k"] == k), lambda x: x["v"])), -1)  # noqa: E731  the last of a repeated index
    return rows.select(*[last(k).alias(f"Sensor_{k}") for k in keys])


def spaced(spark: SparkSession, path: str) -> DataFrame:
    """Columns between runs of white space, named by number; as many as the widest line has; delimited text if that is one."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''")
    width = rows.agg(F.max(F.size(parts))).first()[0] or 0  # one number
    if width < 2:
        return delimited(spark, path)
    names = [f"c{k}" for k in range(width)]
    return _typed(rows.select(*[F.get(parts, k).alias(n) for k, n in enumerate(names)]), names)


READERS = {".json": json, ".jsonl": json, ".parquet": parquet, ".tsv": lambda s, p: delimited(s, p, "\t"), ".arff": arff, ".dat": libsvm, ".zip": zipped}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The reader of the path's suffix, in any case; delimited text (``.gz`` too) for all others."""
    name = path.rstrip("/").lower()
    for suffix, reader in READERS.items():
        if name.endswith(suffix):
            return reader(spark, path)
    return delimited(spark, path)


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Many files as one table: columns by name, null where a file has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, p) for p in paths])


def scrubbed(df: DataFrame) -> DataFrame:
    """NaN as null in every floating point column."""
    nan: list[Column] = [F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")).alias(n) if t in ("float", "double") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(*nan)
