"""Registered queries: one per operator of the inventory.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the result is exactly
expressible in SQL, ``ORACLE[name]`` — DuckDB SQL over the same tables with the
same column names. Double-valued aggregates are rounded to 6 decimals on both
sides so the comparison does not hinge on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# Shared SQL fragments (the oracle side of plans/bindings.py).
SQL_WORKS = """works AS (
  SELECT o_custkey AS author, o_orderkey AS work_id, CAST(o_orderkey AS VARCHAR) AS title,
         CAST(o_orderdate AS DATE) AS pub_date,
         CAST(floor(o_totalprice / 25000.0) AS BIGINT) AS cites,
         CAST(floor(o_totalprice / 25000.0) AS DOUBLE) / (2025 - year(CAST(o_orderdate AS DATE))) AS avg_per_year
  FROM orders)"""

SQL_DATES = """dates AS (
  SELECT o_orderkey AS work_id, o_custkey AS author,
         CAST(floor(o_totalprice / 25000.0) AS BIGINT) AS cites,
         CASE o_orderkey % 7
           WHEN 0 THEN upper(strftime(CAST(o_orderdate AS DATE), '%b %Y'))
           WHEN 1 THEN upper(strftime(CAST(o_orderdate AS DATE), '%b %d %Y'))
           WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR)
           WHEN 3 THEN upper(strftime(CAST(o_orderdate AS DATE), '%b %-d %Y'))
           WHEN 4 THEN upper(strftime(CAST(o_orderdate AS DATE), '%b')) || '-'
                       || upper(strftime(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH, '%b')) || ' '
                       || CAST(year(o_orderdate) AS VARCHAR)
           WHEN 5 THEN CAST(year(o_orderdate) AS VARCHAR) || '.0'
           ELSE 'n/a' END AS pub_date_raw,
         strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS pub_date_dmy
  FROM orders)"""

SQL_CELLS = """cells AS (
  SELECT l_orderkey AS work_id, l_suppkey AS author, year(l_shipdate) AS year,
         sum(l_quantity) AS cites, CAST(l_orderkey AS VARCHAR) AS title
  FROM lineitem GROUP BY l_orderkey, l_suppkey, year(l_shipdate))"""

SQL_PATENTS = """patents AS (
  SELECT upper('u' || CAST(user_id AS VARCHAR)) AS inventor, event_id AS patent, CAST(ts AS DATE) AS filing_date
  FROM events WHERE event_type = 'purchase'),
pubs AS (
  SELECT trim('U' || CAST(user_id AS VARCHAR)) AS author, event_id AS work_id, CAST(ts AS DATE) AS pub_date
  FROM events WHERE event_type <> 'purchase')"""

SQL_COAUTHOR = """coauthor_rows AS (
  SELECT g.l_orderkey AS work_id, 'C' || CAST(o.o_custkey AS VARCHAR) AS author,
         CAST(NULL AS VARCHAR) AS corporate, g.authors
  FROM (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list('P' || CAST(l_partkey AS VARCHAR)))), '; ') AS authors
        FROM lineitem GROUP BY l_orderkey) g
  JOIN orders o ON g.l_orderkey = o.o_orderkey)"""


def sql(*ctes: str, body: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
