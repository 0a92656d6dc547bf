"""Data-quality profiles (Q1-Q6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.schema import SIGNAL_COLUMNS


def non_null_counts(sig: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q1: one row, ``count(c)`` per column."""
    cols = columns or [c for c in ["dataset_id", *SIGNAL_COLUMNS] if c in sig.columns]
    return sig.agg(*[F.count(c).alias(f"nn_{c}") for c in cols])


def distinct_sample(sig: DataFrame, columns=("company", "product_service"), n: int = 5) -> DataFrame:
    """Q2: the first ``n`` distinct values (ascending, NULL first) of each column.

    Each part is a distinct aggregate followed by a bounded top-n.
    """
    parts = [
        sig.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct()
        .orderBy(F.asc_nulls_first("value")).limit(n)
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage_by_source(sig: DataFrame) -> DataFrame:
    """Q3: rows and non-null counts of score, rating, company, product per source."""
    return sig.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("sentiment_score").alias("with_sentiment"),
        F.count("rating").alias("with_rating"),
        F.count("company").alias("with_company"),
        F.count("product_service").alias("with_product"),
    )


def mobile_rating_profile(sig: DataFrame) -> DataFrame:
    """Q4: rating count and mean for the two stores, space-insensitive name match."""
    key = F.replace(F.lower(F.col("source")), F.lit(" "), F.lit(""))
    return (sig.where(key.isin("appstore", "googleplay"))
               .groupBy("source").agg(F.count("rating").alias("rating_count"),
                                      F.avg("rating").alias("avg_rating")))


def rows_by_year_for_source(sig: DataFrame, source: str) -> DataFrame:
    """Q5: rows per year for one source."""
    return sig.where(F.col("source") == source).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


def rows_by_source(sig: DataFrame) -> DataFrame:
    """Q6: rows per source."""
    return sig.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def rows_by_dataset(sig: DataFrame) -> DataFrame:
    """Rows per dataset id (the registry's row_count check)."""
    return sig.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))
