"""The two dictionaries of queries and twins, and the SQL pieces twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CTES = {
    # Order value per priority and day with orders.
    "days": """
        SELECT o_orderpriority AS series_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS n_orders
        FROM orders GROUP BY 1, 2""",
    "ranked_days": """
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos,
               count(*) OVER (PARTITION BY series_id) AS n FROM days""",
    "grid": """
        SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM days GROUP BY series_id""",
    # The same on every day; days without orders have NULL numbers in gaps and 0 in daily.
    "gaps": """
        SELECT g.series_id, g.ts, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos,
               count(*) OVER (PARTITION BY g.series_id) AS n, d.value, d.n_orders
        FROM grid g LEFT JOIN days d ON g.series_id = d.series_id AND g.ts = d.ts""",
    "daily": "SELECT * REPLACE (coalesce(value, 0) AS value, coalesce(n_orders, 0) AS n_orders) FROM gaps",
    "phased": """
        SELECT *, CASE WHEN pos < n*6//10 THEN 'train' WHEN pos < n*6//10 + n*2//10 THEN 'val' ELSE 'test' END AS phase
        FROM daily""",
    # One-step forecast with fixed lag coefficients.
    "fc": """
        SELECT * FROM (
          SELECT series_id, ts, pos, n, phase, value AS y_true,
                 0.5 * lag(value, 1) OVER w + 0.3 * lag(value, 7) OVER w + 0.2 * lag(value, 10) OVER w AS yhat
          FROM phased WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE yhat IS NOT NULL""",
    "naive": """
        SELECT series_id, ts, pos, n, phase, value AS y_true,
               lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM phased""",
    "scaler": """
        SELECT series_id, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s,
               avg(n_orders) AS mo, CASE WHEN stddev_pop(n_orders) = 0 THEN 1 ELSE stddev_pop(n_orders) END AS so
        FROM phased WHERE phase = 'train' GROUP BY series_id""",
    "scaled": """
        SELECT p.series_id, ts, pos, n, phase, (value - m) / s AS z, value FROM phased p JOIN scaler USING (series_id)""",
    # Target and covariate of each series as lists.
    "lists": """
        SELECT p.series_id, any_value(n) AS n, list((value - m) / s ORDER BY pos) AS z, list((n_orders - mo) / so ORDER BY pos) AS zo
        FROM phased p JOIN scaler USING (series_id) GROUP BY 1""",
    "event_days": """
        SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2""",
    # Line items in shipping order as one series.
    "shipments": """
        SELECT l_shipdate AS ts, l_quantity AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus,
               row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                 l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pos,
               count(*) OVER () AS n
        FROM lineitem""",
    # Line items as text with unreadable, missing and infinite cells.
    "dirty": """
        SELECT l_returnflag AS series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN 'not a date'
                    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
               CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'NaN' WHEN l_discount = 0 THEN 'Infinity'
                    WHEN l_tax = 0.01 THEN 'n/a' WHEN l_tax = 0.02 THEN NULL
                    ELSE CAST(l_extendedprice AS VARCHAR) END AS value
        FROM lineitem""",
    "numbers": """
        SELECT *, TRY_CAST(date AS TIMESTAMP) AS ts,
               CASE WHEN isfinite(TRY_CAST(value AS DOUBLE)) THEN TRY_CAST(value AS DOUBLE) END AS x FROM dirty""",
}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; ``ctes`` names the shared pieces its twin builds on, in order."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            pieces = [f"{c} AS ({CTES[c]})" for c in ctes.split()]
            body = sql.strip()
            if not pieces:
                ORACLES[name] = body
            elif body.upper().startswith("WITH "):
                ORACLES[name] = f"WITH RECURSIVE {', '.join(pieces)}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH RECURSIVE {', '.join(pieces)} {body}"
        return run

    return register


DAYS = "days grid gaps daily"
PHASED = f"{DAYS} phased"
FC = f"{PHASED} fc"
SCALED = f"{PHASED} scaler scaled"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cents(window: str) -> Column:
    """The numbers of a flat array in hundredths, as text, for exact comparison."""
    return F.array_join(
        F.transform(window, lambda v: F.round(v * 100).cast("bigint").cast("string")), ",", "-"
    )
