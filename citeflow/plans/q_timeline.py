"""Queries of the patents page (E2) for every inventor at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.operators import timeline as T
from citeflow.operators import works as W
from citeflow.plans import bindings as B
from citeflow.plans.catalog import SQL_PATENTS, SQL_WORKS, register, sql

SQL_DEDUP = """pd AS (SELECT inventor, filing_date, min(patent) AS patent FROM patents GROUP BY inventor, filing_date)"""


ORACLE_BEFORE_AFTER = sql(SQL_PATENTS, SQL_DEDUP, body="""
SELECT *, pubs_after - pubs_before AS change FROM (
SELECT pd.inventor, pd.filing_date, pd.patent,
       (SELECT count(*) FROM pubs p WHERE p.author = pd.inventor AND p.pub_date < pd.filing_date) AS pubs_before,
       (SELECT count(*) FROM pubs p WHERE p.author = pd.inventor AND p.pub_date >= pd.filing_date) AS pubs_after
FROM pd)""")


@register("before_after_count", ORACLE_BEFORE_AFTER)
def q_before_after_count(spark, d):
    return T.before_after_count(B.patents_events(spark, d), B.pubs_events(spark, d))


@register("change_column", sql(SQL_PATENTS, SQL_DEDUP, body="""
SELECT inventor, filing_date, pubs_after - pubs_before AS change FROM (
SELECT pd.inventor, pd.filing_date,
       (SELECT count(*) FROM pubs p WHERE p.author = pd.inventor AND p.pub_date < pd.filing_date) AS pubs_before,
       (SELECT count(*) FROM pubs p WHERE p.author = pd.inventor AND p.pub_date >= pd.filing_date) AS pubs_after
FROM pd)"""))
def q_change_column(spark, d):
    ba = T.before_after_count(B.patents_events(spark, d), B.pubs_events(spark, d))
    return T.change_column(ba.drop("change")).select("inventor", "filing_date", "change")


@register("dedup_keep_first", sql(SQL_PATENTS, SQL_DEDUP, body="SELECT inventor, filing_date, patent FROM pd"))
def q_dedup_keep_first(spark, d):
    return T.dedup_patents(B.patents_events(spark, d))


@register("distinct_patents", sql(SQL_PATENTS, body="SELECT inventor, count(DISTINCT patent) AS patents FROM patents GROUP BY inventor"))
def q_distinct_patents(spark, d):
    return W.distinct_patents(B.patents_events(spark, d))


@register("patents_per_year", sql(SQL_PATENTS, SQL_DEDUP, body="SELECT year(filing_date) AS period, count(*) AS patents FROM pd GROUP BY 1"))
def q_patents_per_year(spark, d):
    return W.patents_per_period(T.dedup_patents(B.patents_events(spark, d)), unit="year")


@register("outer_join_fill", sql(SQL_PATENTS, SQL_WORKS, body="""
SELECT coalesce(w.author, p.inventor) AS author, coalesce(w.publications, 0) AS publications,
       coalesce(w.total_cites, 0) AS total_cites, coalesce(p.patents, 0) AS patents
FROM (SELECT 'U' || CAST(author AS VARCHAR) AS author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites
      FROM works GROUP BY 1) w
FULL OUTER JOIN (SELECT inventor, count(DISTINCT patent) AS patents FROM patents GROUP BY inventor) p
ON w.author = p.inventor"""))
def q_outer_join_fill(spark, d):
    works = B.works_orders(spark, d).withColumn("author", F.concat(F.lit("U"), F.col("author").cast("string")))
    left = W.count_and_sum(works)
    right = W.distinct_patents(B.patents_events(spark, d)).withColumnRenamed("inventor", "author")
    return T.outer_join_fill(left, right, "author", ["publications", "total_cites", "patents"])


@register("outer_join_by_year", sql(SQL_PATENTS, SQL_DEDUP, body="""
SELECT coalesce(a.author, b.author) AS author, coalesce(a.period, b.period) AS period,
       coalesce(a.publications, 0) AS publications, coalesce(b.patents, 0) AS patents
FROM (SELECT author, pub_date AS period, count(*) AS publications FROM pubs WHERE pub_date IS NOT NULL GROUP BY 1, 2) a
FULL OUTER JOIN (SELECT inventor AS author, filing_date AS period, count(*) AS patents FROM pd GROUP BY 1, 2) b
ON a.author = b.author AND a.period = b.period"""))
def q_outer_join_by_year(spark, d):
    pats = T.dedup_patents(B.patents_events(spark, d))
    return T.outer_join_by_period(B.pubs_events(spark, d), pats, unit="day")


@register("ols_trend", sql(SQL_WORKS, """
c AS (SELECT author, year(pub_date) AS year, count(*) AS publications FROM works GROUP BY 1, 2),
f AS (SELECT author, regr_slope(publications, year) AS slope, regr_intercept(publications, year) AS intercept,
             count(*) AS n FROM c GROUP BY author)""", body="""
SELECT c.author, c.year, c.publications, round(f.slope, 6) + 0.0 AS slope, round(f.intercept, 4) + 0.0 AS intercept,
       round(f.intercept + f.slope * c.year, 6) + 0.0 AS fitted
FROM c JOIN f USING (author) WHERE f.n > 1"""))
def q_ols_trend(spark, d):
    t = T.ols_trend(B.works_orders(spark, d))
    # "+ 0.0" folds -0.0 into 0.0 on both sides
    return t.select("author", "year", "publications", (F.round("slope", 6) + 0.0).alias("slope"),
                    (F.round("intercept", 4) + 0.0).alias("intercept"), (F.round("fitted", 6) + 0.0).alias("fitted"))
