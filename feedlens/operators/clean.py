"""Cleaning a raw file into the signal schema.

Narrow projections, and one step that drops rows: no shuffle, runs per input split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions.dates import date_text, lenient_date, parsed_date
from feedlens.functions.text import strip_ws
from feedlens.schema import SIGNAL_COLUMNS, SIGNAL_TYPES


_PARSED, _DATED = "_parsed_date", "_dated"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip + lower-case column names; a collision is an error."""
    names = [c.strip().lower() for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"columns collide after normalisation: {dupes}")
    return df.toDF(*names)


def conform(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Add missing required columns as typed NULL; keep only required ones, in order, and those of ``keep``."""
    have = set(df.columns)
    cols = [F.col(f"`{c}`") if c in have else F.lit(None).cast(SIGNAL_TYPES[c]).alias(c)
            for c in SIGNAL_COLUMNS]
    return df.select(*cols, *keep)


def _nan_to_null(c):
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# The shapes of all texts that a cast accepts: one that fails throws, which takes many times as long
_INT_TEXT = r"(?U)\A[\s\p{Cntrl}]*+[+-]?[0-9]++[\s\p{Cntrl}]*+\z"
_DOUBLE_TEXT = r"(?i)[0-9]|inf|nan"


def _lenient(df: DataFrame, c: str, type_: str, shape: str) -> Column:
    """``try_cast`` of a column of any type."""
    cast = F.col(c).try_cast(type_)
    return F.when(F.col(c).rlike(shape), cast) if isinstance(df.schema[c].dataType, T.StringType) else cast


def _lenient_double(df: DataFrame, c: str) -> Column:
    return _lenient(df, c, "double", _DOUBLE_TEXT)


def _lenient_int(df: DataFrame, c: str) -> Column:
    """An integer, or a number as pandas writes it beside missing ones (``2019.0``), truncated."""
    return F.coalesce(_lenient(df, c, "int", _INT_TEXT), _lenient_double(df, c).try_cast("int"))


def transform_and_clean(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """C1-C7 on a raw frame of any column types; returns the 12 signal columns, and those of ``keep`` as they are.

    C3 lenient casts (``try_cast``: bad values become NULL), C4 defaults
    (score/rating 0.0, text '', country 'Unknown'; NaN is then stored as
    NULL), C5 Unicode whitespace strip on source/company/product, C6 date
    parse with year/month backfilled from the date (an explicit value wins),
    C7 rows without a parsable date are dropped.
    """
    df = conform(normalize_columns(raw), keep)
    if isinstance(df.schema["date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(_PARSED, F.col("date").cast("date"))
    else:
        df = df.withColumn("date", date_text(F.col("date"))).withColumn(_PARSED, parsed_date(F.col("date")))
    # No element, no row.  A filter would be pushed down into the reader together with the parsing, where all that
    # makes a row's text runs once for each mention of it
    df = df.select("*", F.explode(F.array_compact(F.array(_PARSED))).alias(_DATED))
    parsed = F.col(_DATED)
    score = F.coalesce(_lenient_double(df, "sentiment_score"), F.lit(0.0))
    rating = F.coalesce(_lenient_double(df, "rating"), F.lit(0.0))
    return df.select(
        parsed.alias("date"),
        F.coalesce(_lenient_int(df, "year"), F.year(parsed)).alias("year"),
        F.coalesce(_lenient_int(df, "month"), F.month(parsed)).alias("month"),
        F.col("customer_action").cast("string").alias("customer_action"),
        _nan_to_null(score).alias("sentiment_score"),
        F.col("sentiment_label").cast("string").alias("sentiment_label"),
        strip_ws(F.col("source").cast("string")).alias("source"),
        strip_ws(F.col("company").cast("string")).alias("company"),
        strip_ws(F.col("product_service").cast("string")).alias("product_service"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("country").cast("string"), F.lit("Unknown")).alias("country"),
        _nan_to_null(rating).alias("rating"),
        *keep,
    )


def conform_shaped(df: DataFrame, observe: Callable[[DataFrame, dict[str, Column]], DataFrame] | None = None) -> DataFrame:
    """S9 input: an already-shaped signal table, cast to the schema, NOT cleaned.

    All 12 columns are required (the reference's insert has a placeholder
    for each); NULLs are kept.  ``observe`` is called with the table as it came
    and a condition for each column: a value that the schema cannot hold.
    """
    df = normalize_columns(df)
    missing = [c for c in SIGNAL_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"pre-shaped table lacks columns: {missing}")
    shaped = {c: _shaped(df, c) for c in SIGNAL_COLUMNS}
    if observe is not None:
        df = observe(df, {c: F.col(c).isNotNull() & v.isNull() for c, v in shaped.items()})
    return df.select(*[v.alias(c) for c, v in shaped.items()])


def _shaped(df: DataFrame, c: str) -> Column:
    if c == "date":
        return lenient_date(F.col("date"), df.schema["date"].dataType)
    return F.col(c).try_cast(SIGNAL_TYPES[c])
