"""Training-data pipeline over ``documents``: filters, deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor,
and returns a DataFrame that is written and read again as the next one's docs.
All stages but the last return the columns of ``documents``.  Nulls, empty
texts, repeated rows, empty tables and extra columns are handled as each
operator's docstring says; rows with a null doc_id pass the filters that go by
doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.decontamination import decontaminate
from feedlens.llm.line_dedup import dedup_lines
from feedlens.llm.minhash_dedup import near_duplicates
from feedlens.llm.mixing import mix
from feedlens.llm.tables import table, written
from feedlens.llm.toxicity import toxicity


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``gone``."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    judged = toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, written(judged.where("predicted = 1").select("doc_id"), "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of the corpus nearly equals go; documents stay, with n_chars of the rest."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("line_dedup_removed") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8), the document with the smallest doc_id stays."""
    return _without(docs, written(near_duplicates(docs, shingle=5).where(~F.col("kept")).select("doc_id"), "copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, written(judged.where("contaminated").select("doc_id"), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row per copy taken, with its words and position, range-sorted."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# The toxicity model is trained and no SQL; tests/llm holds run() against plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
