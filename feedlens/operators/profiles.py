"""Facets and profiles (O1-O6, Q1, Q3, Q5, Q6) from counts kept with the datasets instead of a scan.

Counts of rows add up over datasets, and datasets never change.  So each
dataset is counted once, by :func:`profile_rows`, and what is asked of all of
them without a filter is a sum over these small rows
(:meth:`feedlens.sources.store.SignalStore.profiles` keeps them).  The results
equal those of the functions of the same names in
:mod:`feedlens.operators.facets` and :mod:`feedlens.operators.quality`.

Distinct values other than of the counted columns (Q2) and means (Q4, whose
sums would depend on the order of additions) are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.operators.facets import DIMENSIONS, options
from feedlens.schema import SIGNAL_COLUMNS

# Counted by source, and over all rows
_COUNTED = [c for c in SIGNAL_COLUMNS]
PROFILE_COLUMNS = "dataset_id bigint, dim string, value string, source string, year int, rows bigint, " + ", ".join(
    f"nn_{c} bigint" for c in _COUNTED)


def profile_rows(sig: DataFrame) -> DataFrame:
    """Counts of each dataset, in one scan and one shuffle of partial counts.

    ``dim`` is one of the facets' dimensions, with the value in ``value``, or
    ``source_year``, by both; a null value is one too.  Rows and non-null
    values of each column are counted for every group.
    """
    columns = [c for c, _ in DIMENSIONS.values()]
    keys = ["dataset_id", *columns]
    sets = [["dataset_id", c] for c in columns] + [["dataset_id", "year", "source"]]
    grouped = sig.groupingSets(sets, *keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"nn_{c}") for c in _COUNTED], F.grouping_id().alias("gid"))

    def gid(cols: list[str]) -> int:
        # bit i from the left is 1 where the key is not grouped
        return int("".join("0" if k in cols else "1" for k in keys), 2)

    dim = F.when(F.col("gid") == gid(sets[-1]), F.lit("source_year"))
    value = F.lit(None).cast("string")
    for (name, (c, _)), cols in zip(DIMENSIONS.items(), sets):
        dim = dim.when(F.col("gid") == gid(cols), F.lit(name))
        value = F.when(F.col("gid") == gid(cols), F.col(c).cast("string")).otherwise(value)
    return grouped.select("dataset_id", dim.alias("dim"), value.alias("value"), "source", "year", "rows",
                          *[f"nn_{c}" for c in _COUNTED])


def facet_options(profiles: DataFrame, tab: str | None = None, **settings) -> DataFrame:
    """O1-O5 without a filter (+ the tab's source allow-list)."""
    counts = (profiles.where(F.col("dim").isin(list(DIMENSIONS)) & F.col("value").isNotNull())
              .groupBy("dim", "value").agg(F.sum("rows").alias("cnt")))
    return options(counts, tab, **settings)


def non_null_counts(profiles: DataFrame) -> DataFrame:
    """Q1: one row, the non-null values of each column.  Any one dimension has every row once."""
    every = profiles.where("dim = 'source'")
    return every.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("nn_dataset_id"),
                     *[F.coalesce(F.sum(f"nn_{c}"), F.lit(0)).alias(f"nn_{c}") for c in _COUNTED])


def coverage_by_source(profiles: DataFrame) -> DataFrame:
    """Q3."""
    return profiles.where("dim = 'source'").groupBy("source").agg(
        F.sum("rows").alias("total"), F.sum("nn_sentiment_score").alias("with_sentiment"),
        F.sum("nn_rating").alias("with_rating"), F.sum("nn_company").alias("with_company"),
        F.sum("nn_product_service").alias("with_product"))


def rows_by_year_for_source(profiles: DataFrame, source: str) -> DataFrame:
    """Q5."""
    return (profiles.where((F.col("dim") == "source_year") & (F.col("source") == source))
            .groupBy("year").agg(F.sum("rows").alias("rows")))


def rows_by_source(profiles: DataFrame) -> DataFrame:
    """Q6."""
    return profiles.where("dim = 'source'").groupBy("source").agg(F.sum("rows").alias("rows"))
