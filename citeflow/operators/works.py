"""Operators over a works table (one row per (author, work)).

Canonical columns (all overridable by parameter): ``author``, ``work_id``,
``title``, ``pub_date`` (date), ``cites`` (number), ``avg_per_year`` (double).
Year matrices are kept *long*: ``(work_id, author, year, cites)``; the wide
form is produced by ``pivot`` with an explicit year list (no extra job).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- P: projections and filters ------------------------------------------------


def year_columns(columns: Iterable[str], lo: int | None = None, hi: int | None = None) -> list[str]:
    """Names that are all digits, optionally bounded (inclusive)."""
    out = []
    for c in columns:
        if c.isdigit():
            y = int(c)
            if (lo is None or y >= lo) and (hi is None or y <= hi):
                out.append(c)
    return out


def year_cols_from(wide: DataFrame, lo: int | None = None, hi: int | None = None,
                   keep: Sequence[str] = ()) -> DataFrame:
    """P1 on a wide matrix: fixed columns ++ digit columns in the bound."""
    return wide.select(*keep, *[F.col(f"`{c}`") for c in year_columns(wide.columns, lo, hi)])


def active_year_columns(wide: DataFrame, years: Sequence[str]) -> list[str]:
    """P2 helper: year columns holding any non-null, non-zero value.

    One aggregate job that returns a single row (one flag per column), so the
    driver only ever sees ``len(years)`` booleans.
    """
    if not years:
        return []
    flags = wide.agg(*[F.max(F.coalesce(F.col(f"`{y}`"), F.lit(0)) != 0).alias(y) for y in years]).first()
    return [y for y in years if flags[y]]


def active_years(cells: DataFrame, year_col: str = "year", cites_col: str = "cites") -> list[int]:
    """P2 on long cells: the years with any non-zero cell, before anything is pivoted."""
    rows = cells.where(F.coalesce(F.col(cites_col), F.lit(0)) != 0).select(F.col(year_col).alias("y")).distinct().where("y is not null")
    return sorted(r.y for r in rows.collect())


def prune_empty_years(wide: DataFrame, keep: Sequence[str], years: Sequence[str] | None = None) -> DataFrame:
    """P2 + P3: fixed columns ++ the year columns that are not empty."""
    years = list(years) if years is not None else year_columns(wide.columns)
    live = active_year_columns(wide, years)
    return wide.select(*keep, *[F.col(f"`{y}`") for y in live])


def project_existing(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep wanted ∩ present (in wanted order); also return the missing names."""
    present = set(df.columns)
    keep = [c for c in wanted if c in present]
    return df.select(*keep), [c for c in wanted if c not in present]


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P5: rename only the columns that exist."""
    for old, new in mapping.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def author_filter(df: DataFrame, author, author_col: str = "author") -> DataFrame:
    """Non-null, non-empty and equal to ``author`` (a value or a Column)."""
    a = F.col(author_col)
    val = author if isinstance(author, Column) else F.lit(author)
    return df.where(a.isNotNull() & (a.cast("string") != "") & (a == val))


def date_range_filter(df: DataFrame, lo: int, hi: int, date_col: str = "pub_date") -> DataFrame:
    """Year of the parsed date within [lo, hi].

    Written as a date range rather than ``year(d) BETWEEN``: a bare
    comparison on the (cast) date column is unwrapped by Catalyst and reaches
    the parquet scan as ``PushedFilters`` (row-group skipping)."""
    d = F.col(date_col)
    return df.where((d >= F.lit(datetime.date(lo, 1, 1))) & (d < F.lit(datetime.date(hi + 1, 1, 1))))


def min_year_filter(df: DataFrame, lo: int = 1960, date_col: str = "pub_date") -> DataFrame:
    """P8 (pushable form, as in P7)."""
    return df.where(F.col(date_col) >= F.lit(datetime.date(lo, 1, 1)))


def not_null_year(df: DataFrame, year_col: str = "year") -> DataFrame:
    """P9."""
    return df.where(F.col(year_col).isNotNull())


def threshold_or_filter(stats: DataFrame, min_pubs: int = 1, min_cites: float = 0,
                        pubs_col: str = "publications", cites_col: str = "sum_cited") -> DataFrame:
    """P10: keep authors with enough works OR enough citations."""
    return stats.where((F.col(pubs_col) >= min_pubs) | (F.col(cites_col) >= min_cites))


def non_null_author(df: DataFrame, author_col: str = "author") -> DataFrame:
    """P11."""
    return df.where(F.col(author_col).isNotNull())


def derived_coauthor(corp, authors) -> Column:
    """``coalesce(corp,'') || '; ' || coalesce(authors,'')``."""
    def s(c):
        return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.concat(s(corp), F.lit("; "), s(authors))


def binary_target(col, year: str | None = None) -> Column:
    """``cell > 0`` with null as false."""
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    return F.coalesce(c > 0, F.lit(False))


# -- A: aggregations -------------------------------------------------------------


def pubs_per_author(works: DataFrame, author_col: str = "author", title_col: str = "title") -> DataFrame:
    """A1: number of non-null titles."""
    return works.groupBy(author_col).agg(F.count(title_col).alias("publications"))


def rows_per_author(works: DataFrame, author_col: str = "author") -> DataFrame:
    """A3: row count (``Publicaciones`` of the top-k page)."""
    return works.groupBy(author_col).agg(F.count(F.lit(1)).alias("publications"))


def row_sum_years(wide: DataFrame, years: Sequence[str]) -> Column:
    """Horizontal sum over year columns, null = 0 (one codegen'd fold)."""
    arr = F.array(*[F.coalesce(F.col(f"`{y}`").cast("double"), F.lit(0.0)) for y in years])
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def cites_per_author(cells: DataFrame, author_col: str = "author", cites_col: str = "cites") -> DataFrame:
    """A2: sum over an author's rows of the row sum over year cells (long form)."""
    return cells.groupBy(author_col).agg(F.sum(F.coalesce(F.col(cites_col), F.lit(0))).alias("sum_cited"))


def author_stats(cells: DataFrame, work_col: str = "work_id", author_col: str = "author",
                 title_col: str = "title", cites_col: str = "cites") -> DataFrame:
    """A1 + A2 + A13 in one plan: per wide row (work) the row sum, then per author
    count(title) and the sum of row sums. Both steps combine map-side."""
    rows = (cells.groupBy(author_col, work_col)
            .agg(F.first(title_col, ignorenulls=True).alias(title_col),
                 F.sum(F.coalesce(F.col(cites_col), F.lit(0))).alias("row_sum")))
    return rows.groupBy(author_col).agg(F.count(title_col).alias("publications"),
                                        F.sum("row_sum").alias("sum_cited"))


def inner_join_stats(cells: DataFrame, work_col: str = "work_id", author_col: str = "author",
                     title_col: str = "title", cites_col: str = "cites") -> DataFrame:
    """Publications and citations of each author that has both. The two
    counts come from one table, so one aggregation gives the joined rows; rows
    without an author join nothing."""
    return author_stats(cells, work_col, author_col, title_col, cites_col).where(F.col(author_col).isNotNull())


def per_year(df: DataFrame, year_col: str = "year", cites_col: str = "cites",
             by: Sequence[str] = ()) -> DataFrame:
    """A4 + A5 (+ A6 with ``by``): works and summed citations per year."""
    return (df.where(F.col(year_col).isNotNull())
            .groupBy(*by, year_col)
            .agg(F.count(F.lit(1)).alias("publications"), F.sum(cites_col).alias("sum_cites")))


def axis_max(series: DataFrame) -> DataFrame:
    """The largest yearly counts (chart axis bounds)."""
    return series.agg(F.max("publications").alias("max_publications"), F.max("sum_cites").alias("max_cites"))


def h_index(works: DataFrame, author_col: str = "author", cites_col: str = "cites") -> DataFrame:
    """Largest h such that the author has h works with at least h citations.

    Sorted descending, h = max_i min(c_i, i). Grouping equal citation values
    first, a value v held by the works ranked up to N_v (N_v = works with
    cites >= v) contributes min(floor(v), N_v). So: pre-aggregate (author,
    cites) -> n (map-side combine, skew-proof), then a running sum over the
    author's *distinct* values only, then a max. Null citations never count.
    """
    return _h_from_hist(_cites_hist(works, author_col, cites_col), author_col)


def _cites_hist(works: DataFrame, author_col: str, cites_col: str, extra: dict | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n"), F.count(cites_col).alias("_nn")]
    for name, expr in (extra or {}).items():
        aggs.append(expr.alias(name))
    return works.groupBy(author_col, F.col(cites_col).alias("_v")).agg(*aggs)


def _h_from_hist(hist: DataFrame, author_col: str, keep: Sequence = ()) -> DataFrame:
    w = Window.partitionBy(author_col).orderBy(F.col("_v").desc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hist.withColumn("_cum", F.sum("_nn").over(w))
    contrib = F.when(F.col("_v").isNotNull(),
                     F.least(F.floor(F.col("_v")).cast("long"), F.col("_cum")))
    return ranked.groupBy(author_col).agg(
        F.greatest(F.coalesce(F.max(contrib), F.lit(0)), F.lit(0)).cast("long").alias("h_index"), *keep)


def author_summary(works: DataFrame, author_col: str = "author", cites_col: str = "cites",
                   avg_col: str = "avg_per_year") -> DataFrame:
    """Per author total citations, mean ``avg_per_year`` and h-index.

    One histogram aggregate carries the partial sums, so the whole summary is
    two exchanges (histogram, then author) and no join.
    """
    hist = _cites_hist(works, author_col, cites_col, {
        "_sum_avg": F.sum(avg_col), "_cnt_avg": F.count(avg_col), "_sum_c": F.sum(cites_col)})
    out = _h_from_hist(hist, author_col, keep=[
        F.sum("_n").alias("publications"),
        F.sum("_sum_c").alias("total_cites"),
        (F.sum("_sum_avg") / F.sum("_cnt_avg")).alias("mean_avg_per_year")])
    return out.select(author_col, "publications", "total_cites", "mean_avg_per_year", "h_index")


def count_and_sum(works: DataFrame, author_col: str = "author", cites_col: str = "cites") -> DataFrame:
    """A10: works and total citations per author (clustering features)."""
    return works.groupBy(author_col).agg(F.count(F.lit(1)).alias("publications"),
                                         F.sum(cites_col).alias("total_cites"))


def distinct_patents(patents: DataFrame, inventor_col: str = "inventor", patent_col: str = "patent") -> DataFrame:
    """Distinct patents per inventor; two-level aggregate, no set per group."""
    return (patents.select(inventor_col, patent_col).distinct()
            .groupBy(inventor_col).agg(F.count(patent_col).alias("patents")))


def patents_per_period(patents: DataFrame, date_col: str = "filing_date", unit: str = "year") -> DataFrame:
    """Rows per filing period (``year`` as in the page, or a finer unit)."""
    period = F.year(date_col) if unit == "year" else F.to_date(F.date_trunc(unit, date_col))
    return patents.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("patents"))


# -- L: top-k, sorts, distinct --------------------------------------------------------


def topk_authors(counts: DataFrame, k: int, author_col: str = "author", n_col: str = "publications", tie_col: str | None = None) -> DataFrame:
    """L1: k largest counts; ties by author ascending (the order pandas keeps
    after a group-by), or by ``tie_col`` (a first-seen place, the order pandas keeps
    when it counts values). ``orderBy().limit()`` plans as TakeOrderedAndProject:
    each task keeps k rows, no global sort."""
    return counts.orderBy(F.col(n_col).desc(), F.col(tie_col or author_col).asc()).limit(k)


def semi_join_topk(works: DataFrame, top: DataFrame, author_col: str = "author") -> DataFrame:
    """Works of the selected authors. ``top`` holds at most k rows (a limit),
    so broadcasting it is bounded by construction."""
    return works.join(F.broadcast(top.select(author_col)), author_col, "left_semi")


def topk_works(works: DataFrame, k: int, lo: int, hi: int, author_col: str = "author",
               date_col: str = "pub_date", keep: Sequence[str] | None = None) -> DataFrame:
    """L2: P7 -> A3 -> L1 -> J4 -> P3 as one lazy plan."""
    rng = date_range_filter(works.where(F.col(date_col).isNotNull()), lo, hi, date_col)
    top = topk_authors(rows_per_author(rng, author_col), k, author_col)
    out = semi_join_topk(rng, top, author_col)
    return out.select(*keep) if keep else out


def sort_stats_desc(stats: DataFrame, by: str = "sum_cited", author_col: str = "author") -> DataFrame:
    """L3: descending on the measure, ties by author."""
    return stats.orderBy(F.col(by).desc(), F.col(author_col).asc())


def distinct_sorted(df: DataFrame, col: str = "author") -> DataFrame:
    """L5."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def input_order(scan: DataFrame, col: str = "input_row") -> DataFrame:
    """A scan of files with the place of each row in the input, from 0: files by name, rows as they stand in them.

    ``scan`` reads files and nothing else (a filter before it would change the numbers). The rows of a split are numbered where they are
    read; the rows before a split are a running sum over one row a split, whatever the splits and the tasks are. Joined back by split,
    so no row is sorted or shuffled for its number (the counts are one row a split; Spark broadcasts them if its size check allows it).
    """
    at = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                     F.monotonically_increasing_id().alias("__at"))
    splits = at.groupBy("__file", "__start").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (at.join(splits.select("__file", "__start", "__low", before.alias("__before")), ["__file", "__start"])
            .withColumn(col, F.col("__before") + F.col("__at") - F.col("__low")).drop("__file", "__start", "__at", "__low", "__before"))


def distinct_first_seen(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Unique values with their first-seen position (an order key, or the place in the input that ``input_order`` gives)."""
    return df.groupBy(col).agg(F.min(order_col).alias("first_seen")).orderBy("first_seen")


def sort_years(series: DataFrame, year_col: str = "year") -> DataFrame:
    """L7."""
    return series.orderBy(year_col)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per key, the one with the smallest ``order_col``.

    ``min(struct(order, ...))`` is an aggregate, so it combines map-side and a
    key holding a third of the rows never lands whole in one task (a
    ``row_number`` window would sort the whole group there).
    """
    if not keep:  # plain min: a hash aggregate (a struct min plans as a sort aggregate)
        return df.groupBy(*keys).agg(F.min(order_col).alias(order_col))
    s = F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in keep])).alias("_first")
    return (df.groupBy(*keys).agg(s)
            .select(*keys, F.col("_first._o").alias(order_col), *[F.col(f"_first.{c}").alias(c) for c in keep]))


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
