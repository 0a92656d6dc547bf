"""Registered queries for readers, cleaning, store, registry and staged import, with oracle SQL.

All files are derived from the driver's tables.  The oracles state the expected
rows on their own and share no code with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import metrics as M
from feedlens.operators.clean import transform_and_clean
from feedlens.operators.filters import SignalFilter
from feedlens.operators.joins import estimated_bytes
from feedlens.plans.testbed import signals_from_tables, with_signals
from feedlens.session import scratch_path, shuffles_dropped
from feedlens.sources import readers
from feedlens.sources.batch import load_files
from feedlens.sources.store import SignalStore
from feedlens.streaming.staged_import import import_staged


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a name of its own."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


# A level that takes half the CPU seconds of the default one, for three tenths more bytes
_GZIP = {"compression": "gzip", "zlib.compress.level": "THREE"}
_CSV_ROWS = 200_000  # of a compressed part, which one task reads


def put_parts(df: DataFrame, path: str, **options) -> None:
    """``df`` as one CSV file in parts, a folder with a name of its own, written by all tasks."""
    with shuffles_dropped(df.sparkSession):
        df.write.options(header=True, **options).csv(path)


# --- dirty files (C1-C7) -----------------------------------------------------

def dirty(sig: DataFrame) -> DataFrame:
    """The derived table as untidy strings: padded and mixed-case headers, eight date layouts, junk, no country."""
    d, m = F.dayofmonth("date") % 9, F.col("month")

    def text(fmt):
        return F.date_format("date", fmt)

    date = (F.when(d == 0, text("yyyy-MM-dd")).when(d == 1, text("yyyy/MM/dd")).when(d == 2, text("dd-MM-yyyy"))
            .when(d == 3, text("dd/MM/yyyy")).when(d == 4, text("yyyy-MM-dd 10:00:00")).when(d == 5, F.lit("not a date"))
            .when(d == 6, text("yyyy")).when(d == 7, text("yyyy-MM"))
            .otherwise(F.concat(F.lit(" "), text("yyyy-MM-dd"), F.lit("\t"))))
    day = F.dayofmonth("date") % 7
    score = (F.when(F.col("sentiment_score").isNull(), "").when(day == 0, "abc").when(day == 1, "NaN")
             .otherwise(F.col("sentiment_score").cast("string")))
    return sig.select(
        date.alias(" Date "),
        F.when(m % 4 == 0, F.lit("")).when(m % 4 == 1, "2019.0").when(m % 4 == 2, F.col("year").cast("string"))
        .otherwise("abc").alias("YEAR"),
        F.when(m % 3 == 0, F.lit(None).cast("string")).when(m % 3 == 1, "12.0").otherwise(m.cast("string")).alias("Month "),
        F.col("customer_action").alias("customer_action"), score.alias("Sentiment_Score"), "sentiment_label",
        F.concat(F.lit(" \t"), "source", F.lit("  ")).alias("SOURCE"),
        F.concat(F.lit(" "), "company", F.lit("\t")).alias("company"), "product_service", "text",
        F.coalesce(F.col("rating").cast("string"), F.lit("")).alias("rating"), F.lit("x").alias("extra"))


SQL_DIRTY = with_signals("""
    SELECT date, CAST(CASE WHEN month IN (1, 5, 9) THEN 2019 ELSE year END AS INT) AS year,
           CAST(CASE WHEN month IN (1, 4, 7, 10) THEN 12 ELSE month END AS INT) AS month, customer_action,
           CASE WHEN sentiment_score IS NULL OR day(date) IN (7, 14, 21, 28) THEN 0.0
                WHEN day(date) IN (1, 8, 15, 22, 29) THEN NULL ELSE sentiment_score END AS sentiment_score,
           sentiment_label, source, company, product_service, COALESCE(text, '') AS text,
           'Unknown' AS country, COALESCE(rating, 0.0) AS rating
    FROM signals WHERE day(date) NOT IN (5, 6, 7, 14, 15, 16, 23, 24, 25)""")


def q_dirty(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_path(spark, 'dirty')}.{fmt}"
        w = dirty(signals_from_tables(spark, sf_dir)).write
        if fmt == "csv":
            (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False).csv(path))
        else:
            getattr(w, fmt)(path)
        return transform_and_clean(readers.route_to_reader(spark, path))
    return run


# --- JSON documents (S3) -------------------------------------------------------

def _record(sig: DataFrame):
    return F.to_json(F.struct(*sig.columns), {"ignoreNullFields": "false"})


# Records of an array, and lines of a file: files are compressed, so that one task reads each
_FILE_ROWS = 50_000
_BLOCKS = 16
# Bytes of lineitem for which all rows go through blocks; beyond it so many go that blocks keep their size
_BLOCK_BYTES = 128 << 20


def _put_lines(values: DataFrame, path: str, rows: int = _FILE_ROWS) -> None:
    """``value`` as text files of ``rows`` rows at most, added to a folder; tasks' rows stay in their order."""
    with shuffles_dropped(values.sparkSession):
        (values.select("value").write.mode("append").options(**_GZIP)
         .option("maxRecordsPerFile", rows).text(path))


def _put_blocks(lines: DataFrame, path: str) -> None:
    """(block, place, value) as text files, a block's lines together by place; blocks spread over files."""
    _put_lines(lines.repartition("block").sortWithinPartitions("block", "place"), path)


def _blocks(spark: SparkSession, place: int, value: str) -> DataFrame:
    """A line for each block."""
    return spark.range(_BLOCKS).select(F.col("id").cast("int").alias("block"), F.lit(place).alias("place"),
                                       F.lit(value).alias("value"))


def _put_arrays(spark: SparkSession, sf_dir: str, path: str, heads: list[tuple[int, str]]) -> None:
    """The records of the derived table as the lines of arrays, a file each; every array ends with a record that has no date.

    ``heads`` are the other lines of an array with their places; records have place 2.  The tasks that make
    the rows write them: an array's first row brings its other lines, and rows are sorted within the task.
    """
    sig = signals_from_tables(spark, sf_dir).drop("dataset_id")
    others = [*heads, (9, '{"source": "none"}\n]')]
    own = F.struct(F.lit(2).alias("place"), F.lit(None).cast("string").alias("value"))
    with_others = F.array(own, *[F.struct(F.lit(i).alias("place"), F.lit(v).alias("value")) for i, v in others])
    # the lower bits of the id number a task's rows
    lines = (sig.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
             .select("*", F.expr(f"_row div {_FILE_ROWS}").alias("_array"),
                     F.explode(F.when(F.col("_row") % _FILE_ROWS == 0, with_others).otherwise(F.array(own))).alias("_line"))
             .sortWithinPartitions("_array", "_line.place"))
    _put_lines(lines.select(F.coalesce("_line.value", F.concat(_record(sig), F.lit(","))).alias("value")), path,
               _FILE_ROWS + len(others))


def q_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with one record a line, the first on the line of the bracket."""
    path = f"{scratch_path(spark, 'arrays')}.json"
    _put_arrays(spark, sf_dir, path, [(0, '[{"source": "none"},')])
    return transform_and_clean(readers.read_json(spark, path))


def q_json_array_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with a record that does not parse at the beginning and one among the others: no other one is lost."""
    path = f"{scratch_path(spark, 'arrays')}.json"
    _put_arrays(spark, sf_dir, path, [(0, "["), (1, '{"date": "2020-01-01", "source": },'),
                                      (2, '{"date": "2020-01-01", "text": "torn,')])
    return transform_and_clean(readers.read_json(spark, path))


def q_json_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines whose first line is torn: no other one is lost, and the torn ones are reported."""
    path = f"{scratch_path(spark, 'lines')}.jsonl"
    sig = signals_from_tables(spark, sf_dir).drop("dataset_id")
    # blocks beyond the first have no torn line, and are written by the tasks that make their rows
    share = 1 + estimated_bytes(spark.read.parquet(f"{sf_dir}/lineitem.parquet")) // _BLOCK_BYTES
    # by columns of lineitem alone, so that each row is joined once
    block = F.pmod(F.xxhash64("date", "customer_action", "sentiment_score", "source", "rating"), F.lit(_BLOCKS * share))
    lines = sig.where(block < _BLOCKS).select(block.cast("int").alias("block"), F.lit(1).alias("place"), _record(sig).alias("value"))
    _put_blocks(lines.union(_blocks(spark, 0, '{"date": "2020-01-01", "source": "CF')), path)
    if share > 1:
        _put_lines(sig.where(block >= _BLOCKS).select(_record(sig).alias("value")), path)
    store = SignalStore(spark, scratch_path(spark, "store"))
    store.ingest(path)
    torn = store.rejected().select(F.regexp_extract("reason", r"^\d+", 0).cast("bigint").alias("torn"))
    return store.signals().drop("dataset_id").withColumn("torn", torn.scalar())


# --- CSV with quoted newlines (S1) ------------------------------------------------

def q_quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with newlines, commas and quotes."""
    path = f"{scratch_path(spark, 'quoted')}.csv"
    sig = signals_from_tables(spark, sf_dir).drop("dataset_id")
    text = F.concat(F.col("product_service"), F.lit(',"\n\n"" x'), F.coalesce("text", F.lit("")), F.lit('\n"'))
    (sig.withColumn("text", text).write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("maxRecordsPerFile", 20_000).csv(path))
    return transform_and_clean(readers.read_csv(spark, path))


CLEAN_ROWS = """
    SELECT date, year, month, customer_action, COALESCE(sentiment_score, 0.0) AS sentiment_score,
           sentiment_label, source, company, product_service, COALESCE(text, '') AS text,
           COALESCE(country, 'Unknown') AS country, COALESCE(rating, 0.0) AS rating
    FROM signals"""
SQL_CLEAN = with_signals(CLEAN_ROWS)


# --- store and registry (S5-S9, R1-R6) --------------------------------------------

def _parts(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    sig = signals_from_tables(spark, sf_dir)
    return {i: sig.where(F.col("dataset_id") == i).drop("dataset_id") for i in (1, 2, 3)}


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[SignalStore, dict[int, DataFrame]]:
    store, parts = SignalStore(spark, scratch_path(spark, "store")), _parts(spark, sf_dir)
    for i, df in parts.items():
        store.append_table(df, f"part {i}")
    return store, parts


def counted_store(spark: SparkSession, sf_dir: str) -> SignalStore:
    """A store whose datasets were counted before the last one came and one that was loaded twice went."""
    store, parts = SignalStore(spark, scratch_path(spark, "store")), _parts(spark, sf_dir)
    for i in (1, 2, 2):
        store.append_table(parts[i], f"part {i}")
    store.profiles()
    store.append_table(parts[3], "part 3")
    store.delete(2)
    return store


def _registry_and_rows(store: SignalStore) -> DataFrame:
    rows = store.signals().groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("visible"))
    return (store.registry().join(rows, "id", "left")
            .select("id", "name", "row_count", F.coalesce("visible", F.lit(0)).cast("bigint").alias("visible")))


def q_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the second of three datasets deleted and loaded again: its id is not used twice."""
    store, parts = _loaded(spark, sf_dir)
    store.delete(2)
    store.append_table(parts[2], "part 2 again")
    return _registry_and_rows(store)


def q_after_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3."""
    store, parts = _loaded(spark, sf_dir)
    store.delete_all()
    store.append_table(parts[1], "anew")
    return _registry_and_rows(store)


def q_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a dataset id and of an unregistered dataset; twice, as it must change nothing more."""
    store, parts = SignalStore(spark, scratch_path(spark, "store")), _parts(spark, sf_dir)
    store.append_table(parts[1], "part 1")
    for df, id_ in ((parts[2], F.lit(7)), (parts[3], F.lit(None))):
        (df.withColumn("dataset_id", id_.cast("bigint")).write.mode("append")
         .partitionBy("dataset_id").parquet(store.signals_path))
    store.reconcile()
    store.reconcile()
    return _registry_and_rows(store)


def _crash_before_registry(spark: SparkSession, sf_dir: str) -> tuple[SignalStore, str]:
    """A store with a staged file's rows that a crash left unregistered, and the staging folder."""
    staging, parts = scratch_path(spark, "staging"), _parts(spark, sf_dir)
    put_parts(parts[1], f"{staging}/one.csv")
    store = SignalStore(spark, scratch_path(spark, "store"))
    listing = readers.list_files(spark, staging).select("path", "modificationTime").first()
    id_ = store.bind([tuple(listing)])[0]
    load_files(store, {listing["path"]: id_})
    return store, staging


def q_reconciled_then_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a registry row are registered, then the import that left them runs again."""
    store, staging = _crash_before_registry(spark, sf_dir)
    store.reconcile()
    import_staged(spark, store, staging, checkpoint=scratch_path(spark, "checkpoint"))
    return _registry_and_rows(store)


def q_lost_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence file is lost after a crash; an id that was given is not given again."""
    store, staging = _crash_before_registry(spark, sf_dir)
    fs, p = _fs(spark, store.sequence_path)
    fs.delete(p, False)
    store.append_table(_parts(spark, sf_dir)[2], "two")
    import_staged(spark, store, staging, checkpoint=scratch_path(spark, "checkpoint"))
    return _registry_and_rows(store)


def q_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small datasets in common files; one of them deleted and one loaded afterwards."""
    store, parts = _loaded(spark, sf_dir)
    store.compact(small_bytes=1 << 40)
    store.vacuum(older_than=0)
    store.delete(2)
    store.append_table(parts[2], "part 2 again")
    store.vacuum(older_than=0)
    return _registry_and_rows(store)


def q_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files of two headers, imported by one plan for each header."""
    staging, sig = scratch_path(spark, "staging"), signals_from_tables(spark, sf_dir).drop("dataset_id")
    half = F.col("year") % 2 == 0
    sig.where(half).repartition(_BLOCKS).write.option("header", True).csv(f"{staging}/even")
    sig.where(~half).select(*reversed(sig.columns)).repartition(_BLOCKS).write.option("header", True).csv(f"{staging}/odd")
    store = SignalStore(spark, scratch_path(spark, "store"))
    import_staged(spark, store, staging, checkpoint=scratch_path(spark, "checkpoint"))
    kind = F.regexp_extract("source_path", "/(even|odd)/", 1).alias("kind")
    rows = store.signals().groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("visible"))
    return store.registry().join(rows, "id").groupBy(kind).agg(F.sum("row_count").alias("row_count"),
                                                               F.sum("visible").alias("visible"))


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    return _loaded(spark, sf_dir)[0].summary()


def q_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged files, one of them imported, others hidden or of another kind."""
    staging, parts = scratch_path(spark, "staging"), _parts(spark, sf_dir)
    for i, name in enumerate(("one.csv", "Two.CSV", "nested/three.csv", ".hidden.csv", "__gone.csv", "~four.csv"), 1):
        put_parts(parts[(i - 1) % 3 + 1], f"{staging}/{name}", maxRecordsPerFile=_CSV_ROWS, **_GZIP)
    put_text(spark, f"{staging}/notes.txt", "none")
    store = SignalStore(spark, scratch_path(spark, "store"))
    store.ingest(f"{staging}/one.csv")
    return store.pending(staging).select("name", "ext", "imported", (F.col("size_bytes") > 0).alias("filled"))


def q_best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder, the CSV at the root is taken before JSON there and Parquet below."""
    staging, parts = scratch_path(spark, "staging"), _parts(spark, sf_dir)
    put_parts(parts[1], f"{staging}/b.csv")
    put_parts(parts[2], f"{staging}/c.csv")
    put_text(spark, f"{staging}/a.json", '{"date": "2020-01-01"}\n')
    put_text(spark, f"{staging}/.a.csv", "date\n2020-01-01\n")
    parts[3].write.parquet(f"{staging}/nested/a.parquet")
    store = SignalStore(spark, scratch_path(spark, "store"))
    store.ingest(staging)
    return store.registry().select("id", "name", "row_count")


def q_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be imported are listed, and do not stop the others."""
    staging, parts = scratch_path(spark, "staging"), _parts(spark, sf_dir)
    put_parts(parts[1], f"{staging}/Good.Csv")
    put_parts(parts[2], f"{staging}/a[2].csv")
    put_text(spark, f"{staging}/empty.csv", "date,source\n")
    put_text(spark, f"{staging}/collide.csv", "date,Source, source\n2020-01-01,a,b\n")
    put_text(spark, f"{staging}/torn.parquet", "PAR1 no parquet")
    put_text(spark, f"{staging}/half.jsonl", '{"date": "2020-01-01"}\n{"date": \n')
    store = SignalStore(spark, scratch_path(spark, "store"))
    import_staged(spark, store, staging, checkpoint=scratch_path(spark, "checkpoint"))
    name = F.element_at(F.split("source_path", "/"), -1)
    return (store.registry().select(name.alias("file"), F.lit("imported").alias("result"), "row_count")
            .union(store.rejected().select(name, F.lit("rejected"), F.lit(None).cast("bigint"))))


def _counted(rows: str) -> str:
    return with_signals(f"SELECT * FROM ({rows}) r")


_N = "(SELECT COUNT(*) FROM signals WHERE dataset_id = {})"


def _row(id_: int, name: str, part: int) -> str:
    n = _N.format(part)
    return f"SELECT CAST({id_} AS BIGINT) AS id, '{name}' AS name, {n} AS row_count, {n} AS visible"


SQL_AFTER_DELETE = _counted(" UNION ALL ".join(
    [_row(1, "part 1", 1), _row(3, "part 3", 3), _row(4, "part 2 again", 2)]))
SQL_AFTER_DELETE_ALL = _counted(_row(4, "anew", 1))
SQL_RECONCILED = _counted(" UNION ALL ".join(
    [_row(1, "part 1", 1), _row(2, "Datos sin registrar (recuperado)", 3), _row(7, "Dataset 7 (recuperado)", 2)]))
SQL_RECONCILED_REPLAYED = _counted(_row(1, "one", 1))
SQL_LOST_SEQUENCE = _counted(" UNION ALL ".join([_row(1, "one", 1), _row(2, "two", 2)]))
SQL_COMPACTED = _counted(" UNION ALL ".join([_row(1, "part 1", 1), _row(3, "part 3", 3), _row(4, "part 2 again", 2)]))
SQL_MANY_FILES = with_signals("""
    SELECT CASE WHEN year % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, COUNT(*) AS row_count, COUNT(*) AS visible
    FROM signals GROUP BY 1""")
SQL_JSON_FIRST_LINE = with_signals(f"SELECT *, CAST({_BLOCKS} AS BIGINT) AS torn FROM ({CLEAN_ROWS})")
SQL_QUOTED_NEWLINES = with_signals(f"""
    SELECT * REPLACE (product_service || ',"' || chr(10) || chr(10) || '"" x' || text || chr(10) || '"' AS text)
    FROM ({CLEAN_ROWS})""")
SQL_SUMMARY = with_signals("SELECT CAST(3 AS BIGINT) AS datasets, COUNT(*) AS rows FROM signals")
SQL_PENDING = with_signals("""
    SELECT name, '.csv' AS ext, false AS imported, EXISTS (SELECT 1 FROM signals WHERE dataset_id = part) AS filled
    FROM (VALUES ('Two.CSV', 2), ('three.csv', 3)) f(name, part)""")
SQL_BEST_FILE = with_signals(f"SELECT CAST(1 AS BIGINT) AS id, 'b' AS name, {_N.format(1)} AS row_count")
SQL_REJECTIONS = with_signals(f"""
    SELECT 'Good.Csv' AS file, 'imported' AS result, {_N.format(1)} AS row_count
    UNION ALL SELECT 'a[2].csv', 'imported', {_N.format(2)}
    UNION ALL SELECT 'half.jsonl', 'imported', CAST(1 AS BIGINT)
    UNION ALL SELECT file, 'rejected', CAST(NULL AS BIGINT)
    FROM (VALUES ('empty.csv'), ('collide.csv'), ('torn.parquet'), ('half.jsonl')) f(file)""")


# --- period modes (F10) ---------------------------------------------------------

_MODES = {
    "range": (SignalFilter.from_period("rango", 1996, 1997, years=[1995], months=[1]), "year >= 1996 AND year <= 1997"),
    "range from the default": (SignalFilter.from_period("rango", None, 2015), "year >= 2010 AND year <= 2015"),
    "range to the default": (SignalFilter.from_period("rango", 1999), "year >= 1999 AND year <= 2027"),
    "years": (SignalFilter.from_period("anios", 1990, 1991, years=["1996", 1998], months=[2]), "year = 1996 OR year = 1998"),
    "years and months": (SignalFilter.from_period("anios_meses", years=[1997], months=[2, 12]),
                         "year = 1997 AND (month = 2 OR month = 12)"),
    "months only": (SignalFilter.from_period("anios_meses", months=[5]), "month = 5"),
    "empty lists": (SignalFilter.from_period("anios_meses", 1996, years=[], months=[]), "true"),
    "unknown": (SignalFilter.from_period("todo", 1996, 1996, years=[1996], sources=["CFPB"]), "source = 'CFPB'"),
}


def q_period_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, out = signals_from_tables(spark, sf_dir), None
    for name, (f, _) in _MODES.items():
        row = M.nps_proxy(sig, f).select(F.lit(name).alias("mode"), "total_signals")
        out = row if out is None else out.union(row)
    return out


SQL_PERIOD_MODES = with_signals(" UNION ALL ".join(
    f"SELECT '{name}' AS mode, COUNT(*) AS total_signals FROM signals WHERE {cond}" for name, (_, cond) in _MODES.items()))


def queries() -> dict:
    return {
        "cleaned_dirty_csv": q_dirty("csv"), "cleaned_dirty_json": q_dirty("json"),
        "cleaned_dirty_parquet": q_dirty("parquet"), "json_array_roundtrip": q_json_array,
        "store_after_delete": q_after_delete, "store_after_delete_all": q_after_delete_all,
        "store_reconciled": q_reconciled, "store_summary": q_summary, "pending_imports": q_pending,
        "best_file": q_best_file, "import_rejections": q_rejections, "period_modes": q_period_modes,
        "json_broken_first_line": q_json_first_line, "json_array_bad_record": q_json_array_bad,
        "csv_quoted_newlines": q_quoted_newlines, "store_reconciled_then_replayed": q_reconciled_then_replayed,
        "store_lost_sequence": q_lost_sequence, "store_compacted": q_compacted, "import_many_files": q_many_files,
    }


def oracle_sql() -> dict:
    return {
        "cleaned_dirty_csv": SQL_DIRTY, "cleaned_dirty_json": SQL_DIRTY, "cleaned_dirty_parquet": SQL_DIRTY,
        "json_array_roundtrip": SQL_CLEAN, "store_after_delete": SQL_AFTER_DELETE,
        "store_after_delete_all": SQL_AFTER_DELETE_ALL, "store_reconciled": SQL_RECONCILED,
        "store_summary": SQL_SUMMARY, "pending_imports": SQL_PENDING, "best_file": SQL_BEST_FILE,
        "import_rejections": SQL_REJECTIONS, "period_modes": SQL_PERIOD_MODES,
        "json_broken_first_line": SQL_JSON_FIRST_LINE, "json_array_bad_record": SQL_CLEAN,
        "csv_quoted_newlines": SQL_QUOTED_NEWLINES, "store_reconciled_then_replayed": SQL_RECONCILED_REPLAYED,
        "store_lost_sequence": SQL_LOST_SEQUENCE, "store_compacted": SQL_COMPACTED, "import_many_files": SQL_MANY_FILES,
    }
