"""File readers.

Every reader returns the raw frame; cleaning is :mod:`feedlens.operators.clean`.
Paths are literal: characters that file globs give a meaning are escaped.  CSV
and JSON are read in splits whatever they hold: records that span lines are
put together from the lines, across the splits' borders too.

With ``keep_path``, :data:`SOURCE_FILE` tells each row's file, so that many
files are read by one plan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.schema import DATA_EXTENSIONS, HIDDEN_PREFIXES, SIGNAL_COLUMNS

# Column of records that a JSON reader could not parse; cleaning ignores it, ingest reports it.
MALFORMED = "_malformed_record"
# Column of a row's file, as a URI (see file_uri).
SOURCE_FILE = "_source_file"


def literal_path(path: str) -> str:
    """``path`` with glob characters escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _literal(paths: str | Sequence[str]) -> list[str]:
    return [literal_path(p) for p in ([paths] if isinstance(paths, str) else paths)]


def file_uri(spark: SparkSession, path: str) -> str:
    """A file's path as Spark names it in its rows' metadata (and :data:`SOURCE_FILE`)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return jvm.java.net.URI(uri.getScheme(), uri.getAuthority(), uri.getPath(), None, None).toString()


def _uri_path(spark: SparkSession, uri: str) -> str:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def _with_place(lines: DataFrame) -> DataFrame:
    """The rows of a file scan with their file, the place of their split in it, and their order in the split."""
    meta = lines.metadataColumn("_metadata")
    return lines.select("*", meta["file_path"].alias("_path"), meta["file_block_start"].alias("_block"),
                        F.monotonically_increasing_id().alias("_line"))


# --- CSV ------------------------------------------------------------------------

_CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


# Quantifiers are possessive: what a quote means never depends on what follows later, and Java matches them in a loop,
# however long the line
_IN_QUOTES = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_IN_QUOTES}"[^,]*+|[^",][^,]*+)?+,)*+"{_IN_QUOTES}\z'
_ENDS_QUOTED = {False: rf"(?s)\A{_FIELDS}", True: rf'(?s)\A{_IN_QUOTES}(?:\z|"[^,]*+,{_FIELDS})'}


def _ends_quoted(line: Column, quoted: bool) -> Column:
    """Whether a line of a CSV ends inside quotes, if it begins inside (``quoted``) or outside of them.

    A quote opens a field only at its beginning; inside, two quotes are a
    character and one closes the field.
    """
    return F.when(line.contains('"'), line.rlike(_ENDS_QUOTED[quoted])).otherwise(F.lit(quoted))


def csv_profile(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file that has a line: (path, header line, number of lines, whether some record spans lines), one scan."""
    lines = _with_place(spark.read.text(_literal(paths))).where(F.trim("value") != "")
    first = F.struct("_block", "_line")
    return lines.groupBy(F.col("_path").alias("path")).agg(
        F.min_by("value", first).alias("header"), F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.bool_or(_ends_quoted(F.col("value"), False)), F.lit(False)).alias("spans"))


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some record of a CSV spans lines: a line that begins outside of quotes ends inside."""
    lines = spark.read.text(literal_path(path))
    return not lines.where(_ends_quoted(F.col("value"), False)).isEmpty()


def csv_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, place, record, crlf) of CSV files whose records may span lines, read in splits.

    ``crlf`` tells whether a carriage return stood before the record's end.

    Each line maps the state before it (inside quotes or not) to the one after
    it: it keeps or swaps the state, or sets it.  A window over a split's lines
    composes these maps, one over the splits of a file, of one row each, gives
    the state a split begins in, and so each line's own.  Lines that are a
    record go on as they are; the lines of the others are joined by the place
    of their first line.  The one exchange of the text is by split.
    """
    lines = _with_place(spark.read.option("lineSep", "\n").text(_literal(paths))).select(
        "_path", "_block", "_line", "value", _ends_quoted(F.col("value"), False).cast("int").alias("out"),
        _ends_quoted(F.col("value"), True).cast("int").alias("in"))
    sets, swap = F.col("out") == F.col("in"), (F.col("out") > F.col("in")).cast("int")
    split = Window.partitionBy("_path", "_block").orderBy("_line")
    upto = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    # parity of the swaps so far, and the state last set, taken back by the swaps before it
    lines = (lines.withColumn("swaps", F.sum(swap).over(upto) % 2)
             .withColumn("set", F.last(F.when(sets, (F.col("out") + F.col("swaps")) % 2), ignorenulls=True).over(upto)))
    ends = lines.groupBy("_path", "_block").agg(F.max_by(F.struct("swaps", "set"), "_line").alias("end"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    file = earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (ends.withColumn("swaps", F.sum("end.swaps").over(file) % 2)
              # swaps within the split count in its own value of "set", those of earlier ones are taken back
              .withColumn("set", F.when(F.col("end.set").isNotNull(), (F.col("end.set") + F.col("end.swaps") + F.col("swaps")) % 2))
              .select("_path", "_block", F.coalesce(F.lag("swaps").over(Window.partitionBy("_path").orderBy("_block")),
                                                    F.lit(0)).alias("swaps_before"),
                      F.coalesce(F.last("set", ignorenulls=True).over(earlier), F.lit(0)).alias("set_before"))
              .select("_path", "_block", ((F.col("set_before") + F.col("swaps_before")) % 2).alias("begin")))
    state = (F.coalesce(F.lag("set").over(split), F.col("begin"))
             + F.coalesce(F.lag("swaps").over(split), F.lit(0))) % 2
    lines = (lines.join(begins, ["_path", "_block"]).withColumn("starts", state == 0)
             .withColumn("whole", F.col("starts") & (F.col("out") == 0)))
    owner = F.last(F.when(F.col("starts"), F.struct("_block", "_line")), ignorenulls=True).over(upto)
    parts = lines.withColumn("place", owner).where(~F.col("whole"))
    # a split's first lines may go on with a record of an earlier one
    lasts = lines.where("starts").groupBy("_path", "_block").agg(F.max(F.struct("_block", "_line")).alias("last"))
    heads = (parts.where(F.col("place").isNull()).select("_path", "_block", "_line", "value").unionByName(
        lasts.select("_path", "_block", "last"), allowMissingColumns=True)
        .withColumn("place", F.last("last", ignorenulls=True).over(
            Window.partitionBy("_path").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)))
        .where(F.col("last").isNull()))
    pieces = parts.where(F.col("place").isNotNull()).select("_path", "place", "_block", "_line", "value").unionByName(
        heads.select("_path", "place", "_block", "_line", "value"))
    joined = (pieces.groupBy("_path", "place")
              .agg(F.sort_array(F.collect_list(F.struct("_block", "_line", "value"))).alias("parts"))
              .select("_path", "place", F.array_join("parts.value", "\n").alias("record")))
    records = lines.where("whole").select("_path", F.struct("_block", "_line").alias("place"),
                                          F.col("value").alias("record")).union(joined)
    crlf = F.col("record").endswith("\r")
    return records.select(
        F.col("_path").alias("path"), "place", crlf.alias("crlf"),
        F.when(crlf, F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")).alias("record")
    ).where(F.trim("record") != "")


def _read_spanning(spark: SparkSession, paths: str | Sequence[str], header: str, keep_path: bool) -> DataFrame:
    """CSV files of one header whose records may span lines, in splits; fields are cut by Spark's own parser."""
    reader = spark.read.options(**_CSV_OPTIONS).option("header", True)
    names = reader.csv(spark.sparkContext.parallelize([header], 1)).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    records = csv_records(spark, paths)
    # a row for each file; where its first line ends with one, carriage returns are part of the line ends in fields too
    first = records.groupBy("path").agg(F.min("place").alias("header_at"), F.min_by("crlf", "place").alias("crlf"))
    record = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    rows = (records.drop("crlf").join(F.broadcast(first), "path").where(F.col("place") != F.col("header_at"))
            .select("path", F.from_csv(record, schema, {**_CSV_OPTIONS, "multiLine": "true"}).alias("r")))
    return rows.select("r.*", "path").toDF(*names, SOURCE_FILE).select(
        *[f"`{n.replace('`', '``')}`" for n in names], *[SOURCE_FILE] * keep_path)


def _fit_splits(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether no file is larger than a split; by the listing alone."""
    jvm = spark.sparkContext._jvm
    bound = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spark.read.format("binaryFile").load(_literal(paths)).where(F.col("length") > bound).isEmpty()


def _with_path(df: DataFrame, keep: bool) -> DataFrame:
    return df.select("*", df.metadataColumn("_metadata")["file_path"].alias(SOURCE_FILE)) if keep else df


def read_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None, header: str | None = None,
             keep_path: bool = False) -> DataFrame:
    """CSV with a header, every column as a string (lenient casts come later).

    Several paths must have the same header.  Files are read in splits.  Where
    a quoted field spans lines, files that are no larger than a split are read
    whole, a task each; if one is larger, the records are put together first
    (:func:`csv_records`).  ``multi_line`` says whether there are such fields;
    None (the default) finds out by one parallel scan.  ``header`` may be given
    where it is known.  A header that itself spans lines makes one task read
    the file.
    """
    if multi_line is None:
        found = csv_profile(spark, path).agg(F.bool_or("spans").alias("spans"), F.min("header").alias("header")).first()
        multi_line, header = bool(found["spans"]), found["header"]
    elif multi_line and header is None:
        header = csv_profile(spark, path).agg(F.min("header")).first()[0]
    whole = bool(multi_line) and (header is None or _spans(header) or _fit_splits(spark, path))
    if multi_line and not whole:
        return _read_spanning(spark, path, header, keep_path)
    reader = spark.read.options(**_CSV_OPTIONS).option("header", True).option("inferSchema", False)
    return _with_path(reader.option("multiLine", whole).csv(_literal(path)), keep_path)


def _spans(line: str) -> bool:
    """Whether a line of a CSV that begins outside of quotes ends inside."""
    return re.fullmatch(r'(?s)(?:(?:[^",][^,]*|"(?:[^"]|"")*"[^,]*)?,)*"(?:[^"]|"")*', line) is not None


# --- Parquet --------------------------------------------------------------------

def read_parquet(spark: SparkSession, path: str | Sequence[str], keep_path: bool = False) -> DataFrame:
    """S2.  Several paths must have the same schema."""
    return _with_path(spark.read.parquet(*_literal(path)), keep_path)


# --- JSON -----------------------------------------------------------------------

# A line that holds one record: an object, maybe between brackets and commas of an array
_RECORD_LINE = r"(?s)^[\[,\s]*(\{.*\})[\],\s]*$"
_SEVERAL = r"\}\s*,?\s*\{"
_KEYS = r'(?i)"\s*(' + "|".join(SIGNAL_COLUMNS) + r')\s*"\s*:'
_BLANK = re.compile(r"[\s,\[\]]*")
_NEXT = re.compile(r"[,\n}\]]\s*(?=\{)")


def _one_record() -> Column:
    """A line that holds one record and no more; most lines are judged by their ends and by having one bracket."""
    value = F.col("value")
    begins = value.startswith("{") & (value.endswith("}") | value.endswith("},"))
    return (begins | value.rlike(_RECORD_LINE)) & ~((F.locate("{", value, 2) > 0) & value.rlike(_SEVERAL))


def _record() -> Column:
    """The record of a line that holds one."""
    value = F.col("value")
    return (F.when(value.startswith("{") & value.endswith("}"), value)
            .when(value.startswith("{") & value.endswith("},"), F.expr("left(value, length(value) - 1)"))
            .otherwise(F.regexp_extract(value, _RECORD_LINE, 1)))


def _blank() -> Column:
    """A line of an array's brackets and commas alone."""
    return F.col("value").rlike(r"^[\[\],\s]*$")


def _other_text() -> Column:
    """A line that holds something else than a record or an array's brackets and commas."""
    return ~_one_record() & ~_blank()


def split_records(text: str) -> list[str]:
    """The records of a JSON text: array, object, or objects one after another.

    What does not parse is a piece by itself, up to the next object that parses
    and has a signal's column; only that piece is lost.
    """
    decode, out, at = json.JSONDecoder(strict=False).raw_decode, [], 0

    def parsed(i: int):
        try:
            return decode(text, i)
        except (ValueError, RecursionError):
            return None, -1

    while (at := _BLANK.match(text, at).end()) < len(text):
        end = parsed(at)[1]
        if end < 0:
            end = len(text)
            for m in _NEXT.finditer(text, at):
                record = parsed(m.end())[0]
                if isinstance(record, dict) and any(k.strip().lower() in SIGNAL_COLUMNS for k in record):
                    end = m.end()
                    break
        out.append(text[at:end].rstrip(", \t\r\n"))
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_records(texts: pd.Series) -> pd.Series:
    return texts.map(split_records)


def json_profile(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file that has a line: path, lines that hold a record, other ones, whether it is a document; one scan."""
    scan = spark.read.text(_literal(paths))
    # each line is judged once
    judged = scan.select("value", scan.metadataColumn("_metadata")["file_path"].alias("path"), _one_record().alias("one")).select(
        "path", "one", (F.col("one") & F.col("value").rlike(_KEYS)).alias("signal"),
        F.when(~F.col("one") & ~_blank(), F.col("value").rlike(r"^[\[,\s]*\{")).alias("begun"))
    files = judged.groupBy("path").agg(
        F.count_if("signal").alias("signals"), F.count_if("one").alias("records"), F.count("begun").alias("others"),
        F.count_if("begun").alias("begun"))
    document = (F.col("others") > 0) & ((F.col("signals") == 0) | (F.col("signals") < F.col("begun")))
    return files.select("path", "records", "others", document.alias("document"))


def read_json(spark: SparkSession, path: str | Sequence[str], keep_path: bool = False) -> DataFrame:
    """S3: JSON documents (arrays or objects) and JSON lines, every value as a string.

    All lines of a file decide, by one scan: if at least as many of them hold a
    record (an object with a signal's column, maybe between an array's brackets
    and commas) as begin an object that goes on, the file is read in splits,
    line by line; else it is one document, which one task cuts into records.
    No schema is inferred: of each record, the signal columns are taken (names
    stripped and in lower case).  Each record is parsed by itself; what does not
    parse stands in :data:`MALFORMED`, and costs no other record.
    """
    scan = spark.read.text(_literal(path))
    lines = scan.select("value", scan.metadataColumn("_metadata")["file_path"].alias(SOURCE_FILE))
    seen = json_profile(spark, path).agg(F.sum(F.when(~F.col("document"), F.col("others"))).alias("others"),
                                         F.collect_list(F.when(F.col("document"), F.col("path"))).alias("documents")).first()
    if seen["documents"]:
        # names of files alone
        names = spark.createDataFrame([(u,) for u in seen["documents"]], f"{SOURCE_FILE} string")
        lines = lines.join(F.broadcast(names), SOURCE_FILE, "left_anti")
    pieces = lines.where(_one_record()).select(SOURCE_FILE, _record().alias("piece"))
    if seen["others"]:
        pieces = pieces.union(lines.where(_other_text()).select(SOURCE_FILE, F.explode(_split_records("value")).alias("piece")))
    if seen["documents"]:
        whole = spark.read.text([literal_path(_uri_path(spark, u)) for u in seen["documents"]], wholetext=True)
        pieces = pieces.union(whole.select(whole.metadataColumn("_metadata")["file_path"].alias(SOURCE_FILE),
                                           F.explode(_split_records("value")).alias("piece")))
    # step by step, so that each is taken once for all columns: the record, its names stripped and in lower case,
    # whether they are distinct
    parsed = pieces.select(SOURCE_FILE, "piece", F.from_json("piece", "map<string,string>").alias("record"))
    named = parsed.select(SOURCE_FILE, "piece", F.map_values("record").alias("values"),
                          F.transform(F.map_keys("record"), lambda k: F.lower(F.trim(k))).alias("names"))
    judged = named.withColumn("fit", F.coalesce(F.size(F.array_distinct("names")) == F.size("names"), F.lit(False))
                              & F.col("names").isNotNull())
    return judged.select(
        *[F.when(F.col("fit"), F.get("values", (F.array_position("names", c) - 1).cast("int"))).alias(c) for c in SIGNAL_COLUMNS],
        F.when(~F.col("fit"), F.substring("piece", 1, 200)).alias(MALFORMED), *[SOURCE_FILE] * keep_path)


READERS = {".csv": read_csv, ".parquet": read_parquet, ".json": read_json, ".jsonl": read_json}


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def route_to_reader(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Pick the reader by lower-cased extension; unknown -> ValueError.  ``multi_line`` is for CSV."""
    ext = extension(path)
    if ext not in READERS:
        raise ValueError(f"unsupported format {ext!r}")
    if ext == ".csv":
        return read_csv(spark, path, multi_line)
    return READERS[ext](spark, path)


def data_path(spark: SparkSession, root: str) -> Column:
    """Of a listed ``path``: the outermost folder below ``root`` that has a data extension, else the file itself."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    prefix = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    below = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 30))
    folder = F.regexp_extract(below, r"(?is)^(.*?\.(?:" + "|".join(e[1:] for e in DATA_EXTENSIONS) + "))/", 1)
    return F.when(folder != "", F.concat(F.lit(prefix), folder)).otherwise(F.col("path"))


def list_files(spark: SparkSession, root: str | Sequence[str], glob: str | None = None, below: str | None = None) -> DataFrame:
    """Recursive file listing (path, name, length, modificationTime); content is never read.

    A folder with a data extension, as Spark writes one, is one file in parts,
    listed with their bytes and latest time.  Of several files, ``below`` is
    the folder that they are staged in.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    load = root if below is None else _literal(root)
    listing = (r.load(load).select(data_path(spark, below or root).alias("path"), "length", "modificationTime").groupBy("path")
               .agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime")))
    return listing.withColumn("name", F.element_at(F.split("path", "/"), -1))


def file_parts(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder that is one file in parts; a file itself otherwise."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return [path]
    return [s.getPath().toString() for s in fs.listStatus(p)
            if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]


def not_hidden(name_col: str = "name"):
    n = F.col(name_col)
    cond = None
    for p in HIDDEN_PREFIXES:
        c = ~n.startswith(p)
        cond = c if cond is None else cond & c
    return cond


def pick_best_file(listing: DataFrame, root: str) -> DataFrame:
    """Choose ONE data file of a folder listing.

    Hidden names (., __, ~) are skipped; files at the root level come before
    nested ones; then parquet < csv < json < jsonl; then path.  Returns a
    one-row DataFrame (empty when no candidate), a bounded top-1.
    """
    prio = F.create_map(*[x for i, e in enumerate(DATA_EXTENSIONS) for x in (F.lit(e), F.lit(i))])
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    root_uri = root.rstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + re.escape(root_uri.split(":", 1)[-1]) + "/", "")
    ranked = (listing.where(not_hidden() & ext.isin(DATA_EXTENSIONS))
              .withColumn("rel", rel)
              .withColumn("nested", F.col("rel").contains("/"))
              .withColumn("priority", prio[ext]))
    return ranked.orderBy("nested", "priority", "rel").limit(1)

