"""Signals derived from the driver's TPC-H-style tables.

No driver table has the signal shape, so one is projected from
``lineitem x supplier x nation x part``.  The projection is written once as
SQL expression text and used by both Spark (``selectExpr``) and the DuckDB
oracle (a ``WITH signals AS (...)`` prefix), so both engines see identical
rows.  Work grows with ``lineitem``: one output row per line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.joins import broadcast_if_small
from feedlens.schema import TAB_CONFIG, VALID_ACTIONS

_TEXTS = ["Wrong CHARGE on my billing", "Rude agent, long wait", "Credit report dispute",
          "Account closed after fraud", "Mortgage payment plan", "App crash at login",
          "Very slow, lag and error", ""]


def _case(key: str, values: list[str], other: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} {whens} ELSE {other} END"


# (name, SQL expression) over the joined row; order = signal column order.
SIGNAL_EXPRS = [
    ("dataset_id", "CAST(l_orderkey % 3 + 1 AS BIGINT)"),
    ("date", "CAST(l_shipdate AS DATE)"),
    ("year", "CAST(year(l_shipdate) AS INT)"),
    ("month", "CAST(month(l_shipdate) AS INT)"),
    ("customer_action", _case("(l_partkey + l_linenumber) % 18", VALID_ACTIONS, "'Churning_typo'")),
    ("sentiment_score",
     "CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DOUBLE) "
     "ELSE CAST((l_quantity - 25) / 32 AS DOUBLE) END"),
    ("sentiment_label",
     "CASE WHEN l_quantity < 17 THEN 'negative' WHEN l_quantity > 34 THEN 'positive' "
     "ELSE 'neutral' END"),
    ("source", _case("l_orderkey % 8", TAB_CONFIG["marketing"]["sources"], "'CFPB'")),
    ("company", "s_name"),
    ("product_service", "p_type"),
    ("text", _case("l_partkey % 9", _TEXTS, "'Nice coffee'")),
    ("country",
     "CASE l_orderkey % 11 WHEN 0 THEN CAST(NULL AS VARCHAR(64)) WHEN 1 THEN 'Unknown' "
     "WHEN 2 THEN 'United States – ' || n_name ELSE 'United States - ' || n_name END"),
    ("rating",
     "CASE WHEN l_linenumber = 6 THEN CAST(NULL AS DOUBLE) "
     "ELSE CAST(l_quantity / 8 AS DOUBLE) END"),
]


def _spark_expr(e: str) -> str:
    return e.replace("VARCHAR(64)", "STRING")


def signals_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived signal table as a lazy DataFrame (schema = ``SIGNALS_SCHEMA``)."""
    rd = spark.read.parquet
    li = rd(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    sup = rd(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    # nation has a fixed 25 rows in every scale factor: a proven broadcast bound.
    nat = F.broadcast(rd(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"))
    part = rd(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    sup_nat = sup.join(nat, sup.s_nationkey == nat.n_nationkey)
    # supplier and part grow with the scale factor: broadcast only under a
    # checked bound of their bytes in memory; beyond it the joins are shuffle joins on the keys.
    joined = (li.join(broadcast_if_small(sup_nat), li.l_suppkey == sup_nat.s_suppkey)
                .join(broadcast_if_small(part), li.l_partkey == part.p_partkey))
    return joined.selectExpr(*[f"{_spark_expr(e)} AS {n}" for n, e in SIGNAL_EXPRS])


SIGNALS_CTE = (
    "signals AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in SIGNAL_EXPRS)
    + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
    + " JOIN nation ON s_nationkey = n_nationkey"
    + " JOIN part ON l_partkey = p_partkey)"
)


def with_signals(sql: str) -> str:
    """Prefix an oracle query with the derived ``signals`` CTE."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {SIGNALS_CTE}, {body[5:]}"
    return f"WITH {SIGNALS_CTE} {body}"
