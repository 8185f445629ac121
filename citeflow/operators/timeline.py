"""Patents vs publications over time: J2, J3, J5, P15, M9 (D1 lives in works).

The page's nested loop (for each patent, count the inventor's publications
before and after its filing date) becomes one window over per-day
histograms: no inequality join, and an author's partition holds at most one
row per distinct day however many works they have.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.operators import works as W


def dedup_patents(patents: DataFrame, inventor_col: str = "inventor", date_col: str = "filing_date",
                  patent_col: str = "patent") -> DataFrame:
    """D1 on patents: one row per (inventor, filing day), the smallest patent id."""
    return W.dedup_keep_first(patents, [inventor_col, date_col], patent_col)


def before_after_count(patents: DataFrame, pubs: DataFrame, inventor_col: str = "inventor",
                       date_col: str = "filing_date", patent_col: str = "patent",
                       author_col: str = "author", pub_date_col: str = "pub_date",
                       years: tuple[int, int] | None = None, dedup: bool = True) -> DataFrame:
    """J5 + P15: per patent row, the inventor's publications dated strictly
    before the filing date, on or after it (equal dates count as after), and
    the change after - before. Inventors without publications get (0, 0);
    publications without a date count in neither. A null inventor matches no
    author, and a patent without a filing date counts (0, 0).

    Plan: publications -> (author, day, n) [map-side combine]; union the patent
    rows; ``sum(n)`` over ``rangeBetween(unboundedPreceding, -1)`` on the day
    number gives *before*; the partition total minus it gives *after*.
    """
    if years:
        lo, hi = dt.date(years[0], 1, 1), dt.date(years[1], 12, 31)
        patents = patents.where(F.col(date_col).between(F.lit(lo), F.lit(hi)))
        pubs = pubs.where(F.col(pub_date_col).between(F.lit(lo), F.lit(hi)))
    if dedup:
        patents = dedup_patents(patents, inventor_col, date_col, patent_col)
    hist = (pubs.where(F.col(pub_date_col).isNotNull() & F.col(author_col).isNotNull())
            .groupBy(F.col(author_col).alias("_k"), F.unix_date(F.col(pub_date_col)).alias("_d"))
            .agg(F.count(F.lit(1)).alias("_n")))
    pats = patents.select(F.col(inventor_col).alias("_k"), F.unix_date(F.col(date_col)).alias("_d"),
                          F.col(inventor_col), F.col(date_col), F.col(patent_col), F.lit(0).cast("long").alias("_n"))
    u = pats.unionByName(hist, allowMissingColumns=True)
    w_before = Window.partitionBy("_k").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("_k")
    dated = F.col("_d").isNotNull()
    before = F.when(dated, F.coalesce(F.sum("_n").over(w_before), F.lit(0))).otherwise(0).cast("long")
    total = F.when(dated, F.sum("_n").over(w_all)).otherwise(0).cast("long")
    out = (u.select("_k", inventor_col, date_col, patent_col, before.alias("pubs_before"), total.alias("_tot"))
           .where(F.col(patent_col).isNotNull()))
    return out.select(inventor_col, date_col, patent_col, "pubs_before",
                      (F.col("_tot") - F.col("pubs_before")).alias("pubs_after"),
                      (F.col("_tot") - 2 * F.col("pubs_before")).alias("change"))


def change_column(df: DataFrame, after: str = "pubs_after", before: str = "pubs_before",
                  name: str = "change") -> DataFrame:
    """P15."""
    return df.withColumn(name, F.col(after) - F.col(before))


def outer_join_fill(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                    fill: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on the key(s), measures of the missing side = 0."""
    j = left.join(right, on, "full")
    cols = fill if fill is not None else [c for c in j.columns if c not in ([on] if isinstance(on, str) else on)]
    return j.fillna(0, subset=list(cols))


def outer_join_by_period(pubs: DataFrame, patents: DataFrame, author_col: str = "author",
                         inventor_col: str = "inventor", pub_date_col: str = "pub_date",
                         date_col: str = "filing_date", unit: str = "year") -> DataFrame:
    """J3 for every author at once: publications and patents per (author,
    period), full outer, zeros filled."""
    def period(c):
        return F.year(c) if unit == "year" else F.to_date(F.date_trunc(unit, c))
    p = (pubs.where(F.col(pub_date_col).isNotNull())
         .groupBy(F.col(author_col).alias("author"), period(pub_date_col).alias("period"))
         .agg(F.count(F.lit(1)).alias("publications")))
    t = (patents.groupBy(F.col(inventor_col).alias("author"), period(date_col).alias("period"))
         .agg(F.count(F.lit(1)).alias("patents")))
    return outer_join_fill(p, t, ["author", "period"], ["publications", "patents"])


def ols_trend(pubs: DataFrame, author_col: str = "author", date_col: str = "pub_date",
              year_col: str | None = None) -> DataFrame:
    """M9: per author, least-squares line publications ~ year over the years
    they published in, with fitted values; authors with a single year are
    skipped (the page draws no line for them). One window per author over the
    (author, year) counts: no join back."""
    yr = F.col(year_col) if year_col else F.year(date_col)
    counts = (pubs.where(yr.isNotNull()).groupBy(F.col(author_col).alias(author_col), yr.alias("year"))
              .agg(F.count(F.lit(1)).alias("publications")))
    w = Window.partitionBy(author_col)
    y, x = F.col("publications").cast("double"), F.col("year").cast("double")
    fit = counts.select(author_col, "year", "publications",
                        F.count(F.lit(1)).over(w).alias("_years"),
                        F.regr_slope(y, x).over(w).alias("slope"),
                        F.regr_intercept(y, x).over(w).alias("intercept"))
    return (fit.where(F.col("_years") > 1)
            .select(author_col, "year", "publications", "slope", "intercept",
                    (F.col("intercept") + F.col("slope") * F.col("year")).alias("fitted")))
