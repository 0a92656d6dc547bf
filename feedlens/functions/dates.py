"""Lenient date parsing and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions.text import strip_ws

# Fixed list of accepted textual date layouts, tried in this order after the
# ISO / timestamp cast.  Each stands with the shape of all texts it may match:
# a parser that fails throws, which takes many times as long as the shape.
DATE_FORMATS = {
    "yyyy/MM/dd": r"^[+-]?\d{4,}/\d\d/\d\d$", "dd-MM-yyyy": r"^\d\d-\d\d-[+-]?\d{4,}$",
    "dd/MM/yyyy": r"^\d\d/\d\d/[+-]?\d{4,}$",
}


def lenient_date(c: Column, dtype: T.DataType) -> Column:
    """Parse a date column of any input type; NULL when nothing matches.

    Date and timestamp inputs are cast directly.  Strings are tried first with
    ``try_cast(... AS DATE)`` (full ISO dates, ``yyyy-MM-dd HH:mm:ss``; a bare
    year or year and month is no date), then with the layouts of
    :data:`DATE_FORMATS`.
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return parsed_date(date_text(c))


def date_text(c: Column) -> Column:
    """The text of a date as it is parsed."""
    return strip_ws(c.cast("string"))


def parsed_date(s: Column) -> Column:
    """The date that a stripped text holds."""
    iso = F.when(s.rlike(r"^[+-]?\d{4,}-\d{1,2}-\d{1,2}"), s.try_cast("date"))
    attempts = [iso] + [F.when(s.rlike(shape), F.try_to_date(s, fmt)) for fmt, shape in DATE_FORMATS.items()]
    return F.coalesce(*attempts)


def quarter_label(month: str = "month") -> Column:
    """'Q1'..'Q4' by month; anything else, NULL included, is 'Q4'."""
    m = F.col(month)
    return (F.when(m.between(1, 3), "Q1")
            .when(m.between(4, 6), "Q2")
            .when(m.between(7, 9), "Q3")
            .otherwise("Q4"))


def month_label(month: str = "month") -> Column:
    """Spanish month abbreviation; NULL outside 1..12."""
    from feedlens.schema import MONTH_LABELS

    pairs = []
    for i, lab in enumerate(MONTH_LABELS, start=1):
        pairs += [F.lit(i), F.lit(lab)]
    return F.try_element_at(F.create_map(*pairs), F.col(month))
