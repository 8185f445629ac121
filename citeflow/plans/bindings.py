"""Bindings of the operators' roles to the driver's test tables.

Each role (works, year matrix, patents, graph input, ...) is a plain
DataFrame derived from the parquet tables, so every registered query reads the
whole tables and its work grows with them. Column pruning and filters reach
the parquet scans because every binding is a lazy ``select``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions import scalars as S

# Fixed values of the bindings (kept identical in the oracle SQL).
CITES_DIVISOR = 25000.0        # orders: cites = floor(o_totalprice / 25000)
AVG_BASE_YEAR = 2025           # avg_per_year = cites / (2025 - year)
TARGET_YEAR = 2001             # P14 target cell
N_LABELS = 7                   # given community labels: md5 bucket mod 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def works_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """works: author = o_custkey, one work per order, cites from the price."""
    o = table(spark, sf_dir, "orders")
    cites = F.floor(F.col("o_totalprice") / CITES_DIVISOR).cast("long")
    d = F.to_date("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("author"),
        F.col("o_orderkey").alias("work_id"),
        F.col("o_orderkey").cast("string").alias("title"),
        d.alias("pub_date"),
        cites.alias("cites"),
        (cites / (F.lit(AVG_BASE_YEAR) - F.year(d))).cast("double").alias("avg_per_year"),
    )


def works_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """works with few, large authors: author = l_suppkey, cites = l_quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("work_id"),
                     F.col("l_quantity").alias("cites"))


def date_shape(d) -> "F.Column":
    """Text date in one of the curated shapes, chosen by the order key."""
    mon = F.upper(F.date_format(d, "MMM"))
    yr = F.year(d).cast("string")
    k = F.col("o_orderkey") % 7
    return (F.when(k == 0, F.concat(mon, F.lit(" "), yr))
            .when(k == 1, F.upper(F.date_format(d, "MMM dd yyyy")))
            .when(k == 2, yr)
            .when(k == 3, F.upper(F.date_format(d, "MMM d yyyy")))
            .when(k == 4, F.concat(mon, F.lit("-"), F.upper(F.date_format(F.add_months(d, 2), "MMM")),
                                   F.lit(" "), yr))
            .when(k == 5, F.concat(yr, F.lit(".0")))
            .otherwise(F.lit("n/a")))


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """works with text dates."""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("work_id"),
        F.col("o_custkey").alias("author"),
        F.floor(F.col("o_totalprice") / CITES_DIVISOR).cast("long").alias("cites"),
        date_shape(d).alias("pub_date_raw"),
        F.date_format(d, "dd/MM/yyyy").alias("pub_date_dmy"),
    )


def citation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long year matrix: one cell per (work, author, year) of lineitem quantity."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author"),
                                                 F.year("l_shipdate").alias("year"), "l_quantity")
    return (by_key(li, "work_id", "author").groupBy("work_id", "author", "year")
            .agg(F.sum("l_quantity").alias("cites"))
            .withColumn("title", F.col("work_id").cast("string")))


def ship_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """The year grid: all years that lineitem has (one small aggregate)."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).distinct().where("y is not null")
    return sorted(r.y for r in rows.collect())


#: Rows of a task that groups lineitem by (nearly) unique keys.
TASK_ROWS = 500_000


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to tasks of about ``TASK_ROWS`` rows, where the session's shuffle partitions would hold more: what a
    task groups does not grow with the table. (Grouping by unique keys gains nothing from a partial aggregate before the shuffle.)"""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cells_by_year(spark: SparkSession, sf_dir: str, years, *keys) -> DataFrame:
    """lineitem's quantities summed by ``keys``, a column a year, in one aggregate (null: no such cell)."""
    li = table(spark, sf_dir, "lineitem").select(*keys, F.year("l_shipdate").alias("_y"), "l_quantity")
    names = [c for c in li.columns if c not in ("_y", "l_quantity")]
    return by_key(li, *names).groupBy(*names).agg(*[F.sum(F.when(F.col("_y") == y, F.col("l_quantity"))).alias(str(y)) for y in years])


def year_matrix(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Wide year matrix, a column for each year of the grid (or of ``years``). Absent cells are null."""
    years = ship_years(spark, sf_dir) if years is None else list(years)
    return cells_by_year(spark, sf_dir, years, F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly cells of each order as a map: work_id, cells (year -> quantity)."""
    per = (table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
           .groupBy(F.col("l_orderkey").alias("work_id"), F.year("l_shipdate").cast("string").alias("y")).agg(F.sum("l_quantity").alias("n")))
    return per.groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("cells"))


def patents_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patents: purchases; inventor names normalised as on the patents page."""
    e = table(spark, sf_dir, "events")
    return (e.where(F.col("event_type") == "purchase")
            .select(S.normalize_name(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("inventor"),
                    F.col("event_id").alias("patent"),
                    F.to_date("ts").alias("filing_date")))


def pubs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """publications: all other events; author names only trimmed."""
    e = table(spark, sf_dir, "events")
    return (e.where(F.col("event_type") != "purchase")
            .select(S.trim_name(F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("author"),
                    F.col("event_id").alias("work_id"),
                    F.to_date("ts").alias("pub_date")))


def coauthor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-export-like rows: author = 'C'||custkey, authors = '; '-joined sorted
    distinct part keys of the order (the delimited co-author list)."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    lists = (li.groupBy("l_orderkey")
             .agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("l_partkey").cast("string")))),
                               "; ").alias("authors")))
    return (lists.join(o.select("o_orderkey", "o_custkey"), lists.l_orderkey == o.o_orderkey)
            .select(F.col("l_orderkey").alias("work_id"),
                    F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("author"),
                    F.lit(None).cast("string").alias("corporate"),
                    F.col("authors")))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-audit input: file = documents.source, one record per text line,
    field count = commas + 1."""
    d = table(spark, sf_dir, "documents")
    line = F.explode(F.split(F.col("text"), "\n"))
    return (d.select(F.col("source").alias("file"), line.alias("line"))
            .select("file", (F.length("line") - F.length(F.regexp_replace("line", ",", "")) + 1).alias("fields")))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels ⋈ documents with a deterministic score p = n/(n+5000)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return (lab.join(doc, "doc_id")
            .select("doc_id", F.col("quality").alias("label"),
                    (F.col("n_chars") / (F.col("n_chars") + F.lit(5000.0))).alias("p")))
