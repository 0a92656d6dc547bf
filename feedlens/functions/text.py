"""Text helpers: keyword-topic counting and whitespace stripping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_ws(c: str | Column) -> Column:
    """Strip leading/trailing Unicode whitespace (tabs, newlines, no-break spaces).

    ``F.trim`` removes spaces only.  Strings that begin and end with a visible
    ASCII character, most of them, are not searched.
    """
    col = F.col(c) if isinstance(c, str) else c
    ends_visible = F.substring(col, 1, 1).between("!", "~") & F.substring(col, -1, 1).between("!", "~")
    return F.when(ends_visible, col).otherwise(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


_REGEX_META = set(".^$*+?()[]{}\\")


def keyword_match(text: Column, pattern: str) -> Column:
    """``text`` contains a match of ``pattern`` (substring search, like ``str.contains``).

    A pattern that is a plain alternation of literal words becomes an OR of
    ``contains`` (byte search in generated code); anything else uses ``rlike``.
    """
    if any(ch in _REGEX_META for ch in pattern):
        return text.rlike(pattern)
    words = pattern.split("|")
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def topic_counts(df: DataFrame, topics: list[tuple[str, str]], text_col: str = "text",
                 label_col: str = "topic", count_col: str = "frequency") -> DataFrame:
    """Multi-label keyword counts in ONE pass over ``df``.

    Each (label, regex) pair counts rows whose lower-cased text contains a
    match (substring semantics, as ``str.contains``).  One global aggregate of
    ``count_if`` per topic (map-side partial aggregation, a single row
    shuffled per task), then ``stack`` turns the row into one row per topic.
    """
    lowered = df.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    aggs = [F.count_if(keyword_match(F.col("_text"), rx)).alias(f"t{i}")
            for i, (_, rx) in enumerate(topics)]
    wide = lowered.agg(*aggs)
    pairs = ", ".join(f"{_sql_str(label)}, t{i}" for i, (label, _) in enumerate(topics))
    return wide.selectExpr(f"stack({len(topics)}, {pairs}) AS ({label_col}, {count_col})")


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
