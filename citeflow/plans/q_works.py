"""Queries over works: filters, projections, aggregates, top-k, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions import scalars as S
from citeflow.operators import works as W
from citeflow.plans import bindings as B
from citeflow.plans.catalog import SQL_CELLS, SQL_COAUTHOR, SQL_DATES, SQL_WORKS, register, sql

R6 = 6  # decimals for double aggregates (both sides)

# Fixed parameters of the registered queries.
TOPK, LO, HI = 5, 1996, 1999


# -- slice 7.2: top-k authors in a date range with summary ----------------------------

@register("topk_summary", sql(SQL_WORKS, """
rng AS (SELECT * FROM works WHERE year(pub_date) BETWEEN 1996 AND 1999),
top AS (SELECT author, count(*) AS n FROM rng GROUP BY author ORDER BY n DESC, author ASC LIMIT 5),
sel AS (SELECT * FROM rng WHERE author IN (SELECT author FROM top)),
ranked AS (SELECT author, cites, row_number() OVER (PARTITION BY author ORDER BY cites DESC NULLS LAST) AS rn FROM sel)""",
body="""
SELECT s.author, s.publications, s.total_cites, s.mean_avg_per_year, h.h_index
FROM (SELECT author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites,
             round(avg(avg_per_year), 6) AS mean_avg_per_year FROM sel GROUP BY author) s
JOIN (SELECT author, count(*) FILTER (WHERE cites >= rn) AS h_index FROM ranked GROUP BY author) h USING (author)
"""))
def q_topk_summary(spark, d):
    works = B.works_orders(spark, d)
    top = W.topk_works(works, TOPK, LO, HI)
    return (W.author_summary(top)
            .withColumn("mean_avg_per_year", F.round("mean_avg_per_year", R6)))


@register("topk_works", sql(SQL_WORKS, """
rng AS (SELECT * FROM works WHERE year(pub_date) BETWEEN 1996 AND 1999),
top AS (SELECT author, count(*) AS n FROM rng GROUP BY author ORDER BY n DESC, author ASC LIMIT 5)""",
body="SELECT author, work_id, title, pub_date, cites, avg_per_year FROM rng WHERE author IN (SELECT author FROM top)"))
def q_topk_works(spark, d):
    return W.topk_works(B.works_orders(spark, d), TOPK, LO, HI,
                        keep=["author", "work_id", "title", "pub_date", "cites", "avg_per_year"])


@register("topk_authors", sql(SQL_WORKS, body="""
SELECT author, count(*) AS publications FROM works WHERE year(pub_date) BETWEEN 1996 AND 1999
GROUP BY author ORDER BY publications DESC, author ASC LIMIT 5"""))
def q_topk_authors(spark, d):
    rng = W.date_range_filter(B.works_orders(spark, d), LO, HI)
    return W.topk_authors(W.rows_per_author(rng), TOPK)


@register("semi_join_topk", sql(SQL_WORKS, """
top AS (SELECT author, count(*) AS n FROM works GROUP BY author ORDER BY n DESC, author ASC LIMIT 10)""",
body="SELECT author, work_id, cites FROM works WHERE author IN (SELECT author FROM top)"))
def q_semi_join_topk(spark, d):
    works = B.works_orders(spark, d)
    top = W.topk_authors(W.rows_per_author(works), 10)
    return W.semi_join_topk(works, top).select("author", "work_id", "cites")


@register("h_index", """
WITH ranked AS (SELECT l_suppkey AS author, l_quantity AS cites,
                       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC NULLS LAST) AS rn
                FROM lineitem)
SELECT author, count(*) FILTER (WHERE cites >= rn) AS h_index FROM ranked GROUP BY author""")
def q_h_index(spark, d):
    return W.h_index(B.works_lineitem(spark, d))


@register("author_summary", sql(SQL_WORKS, """
ranked AS (SELECT author, cites, row_number() OVER (PARTITION BY author ORDER BY cites DESC NULLS LAST) AS rn FROM works)""",
body="""
SELECT s.author, s.publications, s.total_cites, s.mean_avg_per_year, h.h_index
FROM (SELECT author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites,
             round(avg(avg_per_year), 6) AS mean_avg_per_year FROM works GROUP BY author) s
JOIN (SELECT author, count(*) FILTER (WHERE cites >= rn) AS h_index FROM ranked GROUP BY author) h USING (author)
"""))
def q_author_summary(spark, d):
    return W.author_summary(B.works_orders(spark, d)).withColumn(
        "mean_avg_per_year", F.round("mean_avg_per_year", R6))


@register("rows_per_author", sql(SQL_WORKS, body="SELECT author, count(*) AS publications FROM works GROUP BY author"))
def q_rows_per_author(spark, d):
    return W.rows_per_author(B.works_orders(spark, d))


@register("pubs_per_author", sql(SQL_CELLS, """
rows_ AS (SELECT author, work_id, any_value(title) AS title FROM cells GROUP BY author, work_id)""",
body="SELECT author, count(title) AS publications FROM rows_ GROUP BY author"))
def q_pubs_per_author(spark, d):
    cells = B.citation_cells(spark, d)
    rows = cells.groupBy("author", "work_id").agg(F.first("title", ignorenulls=True).alias("title"))
    return W.pubs_per_author(rows)


@register("cites_per_author", sql(SQL_CELLS, body="SELECT author, sum(cites) AS sum_cited FROM cells GROUP BY author"))
def q_cites_per_author(spark, d):
    return W.cites_per_author(B.citation_cells(spark, d))


@register("inner_join_stats", sql(SQL_CELLS, """
rows_ AS (SELECT author, work_id, any_value(title) AS title, sum(coalesce(cites, 0)) AS row_sum FROM cells GROUP BY author, work_id)""",
body="""SELECT p.author, p.publications, c.sum_cited
FROM (SELECT author, count(title) AS publications FROM rows_ GROUP BY author) p
JOIN (SELECT author, sum(row_sum) AS sum_cited FROM rows_ GROUP BY author) c ON p.author = c.author
WHERE p.author IS NOT NULL"""))
def q_inner_join_stats(spark, d):
    return W.inner_join_stats(B.citation_cells(spark, d))


@register("author_stats", sql(SQL_CELLS, """
rows_ AS (SELECT author, work_id, any_value(title) AS title, sum(coalesce(cites, 0)) AS row_sum FROM cells GROUP BY author, work_id)""",
body="SELECT author, count(title) AS publications, sum(row_sum) AS sum_cited FROM rows_ GROUP BY author"))
def q_author_stats(spark, d):
    return W.author_stats(B.citation_cells(spark, d))


@register("threshold_or_filter", sql(SQL_CELLS, """
rows_ AS (SELECT author, work_id, any_value(title) AS title, sum(coalesce(cites, 0)) AS row_sum FROM cells GROUP BY author, work_id),
stats AS (SELECT author, count(title) AS publications, sum(row_sum) AS sum_cited FROM rows_ GROUP BY author)""",
body="SELECT author, publications, sum_cited FROM stats WHERE publications >= 1 OR sum_cited >= 0"))
def q_threshold_or_filter(spark, d):
    return W.threshold_or_filter(W.author_stats(B.citation_cells(spark, d)), 1, 0)


@register("sort_stats_desc", sql(SQL_CELLS, """
rows_ AS (SELECT author, work_id, any_value(title) AS title, sum(coalesce(cites, 0)) AS row_sum FROM cells GROUP BY author, work_id)""",
body="SELECT author, count(title) AS publications, sum(row_sum) AS sum_cited FROM rows_ GROUP BY author ORDER BY sum_cited DESC, author"))
def q_sort_stats_desc(spark, d):
    return W.sort_stats_desc(W.author_stats(B.citation_cells(spark, d)))


@register("count_and_sum", sql(SQL_WORKS, body="SELECT author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites FROM works GROUP BY author"))
def q_count_and_sum(spark, d):
    return W.count_and_sum(B.works_orders(spark, d))


# -- projections and filters --------------------------------------------------------

#: The shipping years of the test tables, as the Spark side reads them from the data.
SQL_YEARS = range(1995, 2002)
SQL_WIDE = "wide AS (SELECT l_orderkey AS work_id, l_suppkey AS author, " + ", ".join(
    f'sum(l_quantity) FILTER (WHERE year(l_shipdate) = {y}) AS "{y}"' for y in SQL_YEARS) + " FROM lineitem GROUP BY work_id, author)"


@register("year_cols_from", sql(SQL_WIDE, body="SELECT work_id, author, COLUMNS('^(199[7-9]|[2-9][0-9]{3})$') FROM wide"))
def q_year_cols_from(spark, d):
    return W.year_cols_from(B.year_matrix(spark, d), lo=1997, keep=["work_id", "author"])


@register("project_columns", sql(SQL_WIDE, body="SELECT * FROM wide"))
def q_project_columns(spark, d):
    wide = B.year_matrix(spark, d)
    return wide.select("work_id", "author", *[F.col(f"`{y}`") for y in W.year_columns(wide.columns)])


@register("prune_empty_years", sql("""
cells AS (SELECT l_orderkey AS work_id, l_suppkey AS author, year(l_shipdate) AS year, sum(l_quantity) AS cites
          FROM lineitem GROUP BY 1, 2, 3),
active AS (SELECT DISTINCT year FROM cells WHERE cites <> 0)""", body="""
SELECT w.work_id, w.author, a.year, c.cites
FROM (SELECT DISTINCT work_id, author FROM cells) w CROSS JOIN active a
LEFT JOIN cells c ON c.work_id = w.work_id AND c.author = w.author AND c.year = a.year"""))
def q_prune_empty_years(spark, d):
    """The active years from the long cells, one pivot over them, then back to long with ``unpivot`` (kept cells,
    nulls included) so the data-dependent schema can be compared."""
    years = W.active_years(B.citation_cells(spark, d))
    wide = B.year_matrix(spark, d, years)
    long = wide.unpivot(["work_id", "author"], [F.col(f"`{y}`") for y in years], "year", "cites")
    return long.select("work_id", "author", F.col("year").cast("int").alias("year"), "cites")


@register("project_existing", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_project_existing(spark, d):
    out, _missing = W.project_existing(B.table(spark, d, "orders"),
                                       ["o_orderkey", "o_custkey", "no_such_column", "o_totalprice"])
    return out


@register("rename_columns", "SELECT o_custkey AS author, o_orderkey AS work_id, o_orderdate FROM orders")
def q_rename_columns(spark, d):
    o = B.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.rename_columns(o, {"o_custkey": "author", "o_orderkey": "work_id", "absent": "x"})


@register("author_filter", sql(SQL_WORKS, """
pick AS (SELECT author FROM works GROUP BY author ORDER BY count(*) DESC, author LIMIT 1)""",
body="SELECT author, work_id, pub_date, cites FROM works WHERE author = (SELECT author FROM pick)"))
def q_author_filter(spark, d):
    works = B.works_orders(spark, d)
    pick = W.topk_authors(W.rows_per_author(works), 1)
    # the searched author enters as a scalar subquery (one row by construction)
    return W.author_filter(works, _scalar(pick, "author")).select("author", "work_id", "pub_date", "cites")


def _scalar(df, col):
    """A one-row, one-column DataFrame as a scalar subquery Column."""
    return df.select(col).scalar()


@register("date_range_filter", sql(SQL_WORKS, body="SELECT author, work_id, pub_date FROM works WHERE year(pub_date) BETWEEN 1996 AND 1999"))
def q_date_range_filter(spark, d):
    return W.date_range_filter(B.works_orders(spark, d), LO, HI).select("author", "work_id", "pub_date")


SQL_LENIENT = """coalesce(try_strptime(pub_date_raw, '%b %Y'), try_strptime(pub_date_raw, '%b %d %Y'),
                 try_strptime(pub_date_raw, '%Y'), try_strptime(pub_date_raw, '%d/%m/%Y'),
                 try_strptime(pub_date_raw, '%Y-%m-%d'))::DATE"""


@register("min_year_filter", sql(SQL_DATES, body=f"""
SELECT work_id, author, pub_date FROM (SELECT work_id, author, {SQL_LENIENT} AS pub_date FROM dates)
WHERE year(pub_date) >= 1960"""))
def q_min_year_filter(spark, d):
    ds = B.date_strings(spark, d).select("work_id", "author", S.lenient_date("pub_date_raw").alias("pub_date"))
    return W.min_year_filter(ds, 1960)


@register("not_null_year", sql(SQL_DATES, body="""
SELECT work_id, pub_date_raw, year FROM (
  SELECT work_id, pub_date_raw, CAST(nullif(regexp_extract(pub_date_raw, '\\d{4}', 0), '') AS INTEGER) AS year FROM dates)
WHERE year IS NOT NULL"""))
def q_not_null_year(spark, d):
    ds = B.date_strings(spark, d).select("work_id", "pub_date_raw", S.regex_year("pub_date_raw").alias("year"))
    return W.not_null_year(ds)


@register("non_null_author", sql(SQL_COAUTHOR, body="SELECT work_id, author FROM coauthor_rows WHERE author IS NOT NULL"))
def q_non_null_author(spark, d):
    return W.non_null_author(B.coauthor_rows(spark, d)).select("work_id", "author")


@register("derived_coauthor", sql(SQL_COAUTHOR, body="""
SELECT work_id, author, coalesce(corporate, '') || '; ' || coalesce(authors, '') AS coauthor FROM coauthor_rows"""))
def q_derived_coauthor(spark, d):
    rows = B.coauthor_rows(spark, d)
    return rows.select("work_id", "author", W.derived_coauthor("corporate", "authors").alias("coauthor"))


@register("binary_target", """
SELECT l_orderkey AS work_id, l_suppkey AS author, coalesce(sum(l_quantity) FILTER (WHERE year(l_shipdate) = 2001) > 0, false) AS target
FROM lineitem GROUP BY 1, 2""")
def q_binary_target(spark, d):
    years = sorted({*B.ship_years(spark, d), B.TARGET_YEAR})
    wide = B.year_matrix(spark, d, years)
    return wide.select("work_id", "author", W.binary_target(str(B.TARGET_YEAR)).alias("target"))


@register("row_sum_years", """
SELECT l_orderkey AS work_id, l_suppkey AS author, round(coalesce(sum(l_quantity), 0), 6) AS row_sum FROM lineitem GROUP BY 1, 2""")
def q_row_sum_years(spark, d):
    wide = B.year_matrix(spark, d)
    years = W.year_columns(wide.columns)
    return wide.select("work_id", "author", F.round(W.row_sum_years(wide, years), R6).alias("row_sum"))


# -- per-year series (regex year of the text dates) ----------------------------------------

SQL_RY = "CAST(nullif(regexp_extract(pub_date_raw, '\\d{4}', 0), '') AS INTEGER)"


@register("pubs_per_year", sql(SQL_DATES, body=f"""
SELECT year, count(*) AS publications FROM (SELECT {SQL_RY} AS year FROM dates) WHERE year IS NOT NULL GROUP BY year"""))
def q_pubs_per_year(spark, d):
    ds = B.date_strings(spark, d).select(S.regex_year("pub_date_raw").alias("year"), "cites")
    return W.per_year(ds).select("year", "publications")


@register("cites_per_year", sql(SQL_DATES, body=f"""
SELECT year, CAST(sum(cites) AS BIGINT) AS sum_cites FROM (SELECT {SQL_RY} AS year, cites FROM dates) WHERE year IS NOT NULL GROUP BY year"""))
def q_cites_per_year(spark, d):
    ds = B.date_strings(spark, d).select(S.regex_year("pub_date_raw").alias("year"), "cites")
    return W.per_year(ds).select("year", "sum_cites")


@register("author_year_series", sql(SQL_DATES, body=f"""
SELECT author, year, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS sum_cites
FROM (SELECT author, {SQL_RY} AS year, cites FROM dates) WHERE year IS NOT NULL GROUP BY author, year"""))
def q_author_year_series(spark, d):
    ds = B.date_strings(spark, d).select("author", S.regex_year("pub_date_raw").alias("year"), "cites")
    return W.per_year(ds, by=["author"])


@register("axis_max", sql(SQL_DATES, body=f"""
SELECT max(publications) AS max_publications, max(sum_cites) AS max_cites FROM (
  SELECT year, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS sum_cites
  FROM (SELECT {SQL_RY} AS year, cites FROM dates) WHERE year IS NOT NULL GROUP BY year)"""))
def q_axis_max(spark, d):
    ds = B.date_strings(spark, d).select(S.regex_year("pub_date_raw").alias("year"), "cites")
    return W.axis_max(W.per_year(ds))


@register("sort_years", sql(SQL_DATES, body=f"""
SELECT year, count(*) AS publications FROM (SELECT {SQL_RY} AS year FROM dates) WHERE year IS NOT NULL
GROUP BY year ORDER BY year"""))
def q_sort_years(spark, d):
    ds = B.date_strings(spark, d).select(S.regex_year("pub_date_raw").alias("year"), "cites")
    return W.sort_years(W.per_year(ds).select("year", "publications"))


@register("distinct_authors_sorted", sql(SQL_WORKS, body="SELECT DISTINCT author FROM works WHERE author IS NOT NULL ORDER BY author"))
def q_distinct_authors_sorted(spark, d):
    return W.distinct_sorted(B.works_orders(spark, d), "author")


@register("distinct_first_seen", sql(SQL_WORKS, body="SELECT author, min(work_id) AS first_seen FROM works GROUP BY author ORDER BY first_seen"))
def q_distinct_first_seen(spark, d):
    return W.distinct_first_seen(B.works_orders(spark, d), "author", "work_id")


#: Rows as they stand in the file.
SQL_INPUT = """numbered AS (SELECT l_partkey AS author, l_suppkey AS source, l_orderkey AS work_id, row_number() OVER () - 1 AS input_row FROM lineitem)"""


def _numbered(spark, d):
    rows = W.input_order(B.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"))
    return rows.select(F.col("l_partkey").alias("author"), F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("work_id"), "input_row")


@register("first_seen_in_input", sql(SQL_INPUT, body="SELECT author, min(input_row) AS first_seen FROM numbered GROUP BY author ORDER BY first_seen"))
def q_first_seen_in_input(spark, d):
    """L6 in the order of the input."""
    return W.distinct_first_seen(_numbered(spark, d), "author", "input_row")


@register("keep_first_in_input", sql(SQL_INPUT, body="""
SELECT author, source, min(input_row) AS input_row, arg_min(work_id, input_row) AS work_id FROM numbered GROUP BY author, source"""))
def q_keep_first_in_input(spark, d):
    """D1 in the order of the input: of the rows of a key the one that stands first stays."""
    return W.dedup_keep_first(_numbered(spark, d), ["author", "source"], "input_row", keep=["work_id"])


@register("topk_first_seen_ties", sql(SQL_INPUT, body="""
SELECT author, count(*) AS publications, min(input_row) AS first_seen FROM numbered GROUP BY author
ORDER BY publications DESC, first_seen LIMIT 25"""))
def q_topk_first_seen_ties(spark, d):
    """L1 with ties in the order of the input."""
    counts = _numbered(spark, d).groupBy("author").agg(F.count(F.lit(1)).alias("publications"), F.min("input_row").alias("first_seen"))
    return W.topk_authors(counts, 25, tie_col="first_seen")


# -- scalars ---------------------------------------------------------------------------------

@register("regex_year", sql(SQL_DATES, body=f"SELECT work_id, pub_date_raw, {SQL_RY} AS year FROM dates"))
def q_regex_year(spark, d):
    return B.date_strings(spark, d).select("work_id", "pub_date_raw", S.regex_year("pub_date_raw").alias("year"))


@register("lenient_date", sql(SQL_DATES, body=f"SELECT work_id, pub_date_raw, {SQL_LENIENT} AS pub_date FROM dates"))
def q_lenient_date(spark, d):
    return B.date_strings(spark, d).select("work_id", "pub_date_raw", S.lenient_date("pub_date_raw").alias("pub_date"))


@register("strict_dmy_date", sql(SQL_DATES, body="SELECT work_id, pub_date_dmy, strptime(pub_date_dmy, '%d/%m/%Y')::DATE AS filing_date FROM dates"))
def q_strict_dmy_date(spark, d):
    return B.date_strings(spark, d).select("work_id", "pub_date_dmy",
                                           S.strict_dmy_date("pub_date_dmy").alias("filing_date"))


@register("trim_name", """
SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5,
       length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_chars
FROM documents""")
def q_trim_name(spark, d):
    t = S.trim_name("text")
    return B.table(spark, d, "documents").select("doc_id", F.md5(t).alias("text_md5"),
                                                 F.length(t).alias("n_chars"))


@register("normalize_name", """
SELECT doc_id, md5(upper(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'))) AS text_md5
FROM documents""")
def q_normalize_name(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(S.normalize_name("text")).alias("text_md5"))


@register("clean_text", r"""
SELECT doc_id, md5(array_to_string(list_filter(
         string_split_regex(trim(regexp_replace(regexp_replace(
             regexp_replace(strip_accents(text), '[\p{C}\p{Zl}\p{Zp}]|[^\P{Zs} ]', '', 'g'),
             '\p{Nd}+', '', 'g'), ' +', ' ', 'g')), ' '),
         lambda w: length(w) > 1), ' ')) AS text_md5
FROM documents""")
def q_clean_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(S.clean_text("text")).alias("text_md5"))


@register("split_explode", sql(SQL_COAUTHOR, body="""
SELECT work_id, unnest(list_filter(string_split(authors, '; '), lambda x: x <> '')) AS coauthor FROM coauthor_rows"""))
def q_split_explode(spark, d):
    return B.coauthor_rows(spark, d).select("work_id", S.split_explode("authors").alias("coauthor"))


@register("fill_zero", sql(SQL_WORKS, body="""
SELECT c.c_custkey AS author, coalesce(w.publications, 0) AS publications, coalesce(w.total_cites, 0) AS total_cites
FROM customer c LEFT JOIN (SELECT author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites
                           FROM works GROUP BY author) w ON c.c_custkey = w.author"""))
def q_fill_zero(spark, d):
    cust = B.table(spark, d, "customer").select(F.col("c_custkey").alias("author"))
    agg = W.count_and_sum(B.works_orders(spark, d))
    j = cust.join(agg, "author", "left")
    return j.select("author", S.fill_zero("publications").alias("publications"),
                    S.fill_zero("total_cites").alias("total_cites"))


@register("union_files", sql(SQL_WORKS, """
pubs AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS author, event_id AS work_id, CAST(ts AS DATE) AS pub_date FROM events WHERE event_type <> 'purchase')""",
body="""SELECT CAST(author AS VARCHAR) AS author, work_id, pub_date, cites FROM works
UNION ALL SELECT author, work_id, pub_date, NULL FROM pubs"""))
def q_union_files(spark, d):
    works = B.works_orders(spark, d).select(F.col("author").cast("string").alias("author"), "work_id", "pub_date", "cites")
    pubs = B.pubs_events(spark, d).select("author", "work_id", "pub_date")
    return W.union_files([works, pubs])


# -- E4: search one author (profile summary and yearly series) ----------------------------------

@register("search_author_summary", sql(SQL_WORKS, """
pick AS (SELECT author FROM works GROUP BY author ORDER BY count(*) DESC, author LIMIT 1),
sel AS (SELECT * FROM works WHERE author = (SELECT author FROM pick) AND year(pub_date) >= 1960),
ranked AS (SELECT author, cites, row_number() OVER (PARTITION BY author ORDER BY cites DESC NULLS LAST) AS rn FROM sel)""",
body="""
SELECT s.author, s.publications, s.total_cites, s.mean_avg_per_year, h.h_index
FROM (SELECT author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites,
             round(avg(avg_per_year), 6) AS mean_avg_per_year FROM sel GROUP BY author) s
JOIN (SELECT author, count(*) FILTER (WHERE cites >= rn) AS h_index FROM ranked GROUP BY author) h USING (author)"""))
def q_search_author_summary(spark, d):
    """P6 (the searched author) -> P8 (dates from 1960) -> A8 summary."""
    works = B.works_orders(spark, d)
    pick = W.topk_authors(W.rows_per_author(works), 1)
    mine = W.min_year_filter(W.author_filter(works, _scalar(pick, "author")), 1960)
    return W.author_summary(mine).withColumn("mean_avg_per_year", F.round("mean_avg_per_year", R6))


@register("search_author_series", sql(SQL_DATES, f"""
pick AS (SELECT author FROM dates GROUP BY author ORDER BY count(*) DESC, author LIMIT 1)""", body=f"""
SELECT year, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS sum_cites
FROM (SELECT {SQL_RY} AS year, cites FROM dates WHERE author = (SELECT author FROM pick))
WHERE year IS NOT NULL GROUP BY year"""))
def q_search_author_series(spark, d):
    """E4 chart input: the searched author's works and citations per regex year (A4 + A5)."""
    ds = B.date_strings(spark, d)
    pick = W.topk_authors(W.rows_per_author(ds), 1)
    mine = W.author_filter(ds, _scalar(pick, "author"))
    return W.per_year(mine.select(S.regex_year("pub_date_raw").alias("year"), "cites"))


# -- L2 in full: top-k works with their non-empty year columns ----------------------------------

TOPK_FIRST_YEAR = 1995  # year columns considered (the page's ">= first year" cut)


def works_with_years(spark, d):
    """The publications table: works (orders) plus one citation column per
    year of the grid (lineitem quantity by ship year), 0 where none."""
    years = B.ship_years(spark, d)
    cells = B.cells_by_year(spark, d, years, F.col("l_orderkey").alias("work_id"))
    t = B.works_orders(spark, d).join(cells, "work_id", "left")
    return t.select(*[c for c in t.columns if not c.isdigit()],
                    *[S.fill_zero(F.col(f"`{y}`")).cast("double").alias(str(y)) for y in years])


@register("topk_works_years", sql(SQL_WORKS, """
cells AS (SELECT l_orderkey AS work_id, year(l_shipdate) AS year, sum(l_quantity) AS cites FROM lineitem GROUP BY 1, 2),
rng AS (SELECT * FROM works WHERE year(pub_date) BETWEEN 1996 AND 1999),
live AS (SELECT DISTINCT c.year FROM rng JOIN cells c USING (work_id)
         WHERE c.year >= 1995 AND c.cites <> 0),
top AS (SELECT author, count(*) AS n FROM rng GROUP BY author ORDER BY n DESC, author ASC LIMIT 5),
sel AS (SELECT * FROM rng WHERE author IN (SELECT author FROM top))""", body="""
SELECT s.author, s.work_id, l.year, coalesce(c.cites, 0.0) AS cites
FROM sel s CROSS JOIN live l LEFT JOIN cells c ON c.work_id = s.work_id AND c.year = l.year"""))
def q_topk_works_years(spark, d):
    """L2 as on the page: P7 -> P2 over the *filtered* rows (before the top-k
    cut) -> A3 -> L1 -> J4 -> P3. The kept year columns are data-dependent,
    so the result is returned unpivoted (one row per work and kept year)."""
    pubs = works_with_years(spark, d)
    rng = W.date_range_filter(pubs, LO, HI)
    live = W.active_year_columns(rng, W.year_columns(pubs.columns, lo=TOPK_FIRST_YEAR))
    top = W.topk_authors(W.rows_per_author(rng), TOPK)
    out = W.semi_join_topk(rng, top).select("author", "work_id", *[F.col(f"`{y}`") for y in live])
    long = out.unpivot(["author", "work_id"], [F.col(f"`{y}`") for y in live], "year", "cites")
    return long.select("author", "work_id", F.col("year").cast("int").alias("year"), "cites")
