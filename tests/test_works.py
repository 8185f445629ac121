import datetime as dt

from pyspark.sql import functions as F

from citeflow.operators import works as W


def test_h_index_fixtures(spark):
    rows = [("a", float(c)) for c in [10, 8, 5, 4, 3]] + [("b", 0.0), ("b", 0.0)] + [("c", 3.0), ("c", None)] + \
           [("d", 1.0), ("d", 1.0), ("d", 1.0)] + [("e", 2.5), ("e", 7.0), ("e", 7.0)]
    df = spark.createDataFrame(rows, "author string, cites double")
    got = {r.author: r.h_index for r in W.h_index(df).collect()}
    assert got == {"a": 4, "b": 0, "c": 1, "d": 1, "e": 2}


def test_h_index_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(f"a{rnd.randrange(20)}", float(rnd.randrange(0, 40))) for _ in range(2000)]
    got = {r.author: r.h_index for r in W.h_index(spark.createDataFrame(rows, "author string, cites double")).collect()}
    by = {}
    for a, c in rows:
        by.setdefault(a, []).append(c)
    for a, cs in by.items():
        cs = sorted(cs, reverse=True)
        h = 0
        for i, c in enumerate(cs):
            if c >= i + 1:
                h = i + 1
            else:
                break
        assert got[a] == h


def test_author_summary(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 2, 3.0), ("b", 0, None)],
                               "author string, cites long, avg_per_year double")
    got = {r.author: tuple(r)[1:] for r in W.author_summary(df).collect()}
    assert got == {"a": (2, 12, 2.0, 2), "b": (1, 0, None, 0)}


def test_topk_ties_by_name(spark):
    rows = [("d", 1)] + [("c", 1)] * 2 + [("b", 1)] * 2 + [("a", 1)] * 2
    df = spark.createDataFrame(rows, "author string, x int")
    top = W.topk_authors(W.rows_per_author(df), 2)
    assert [r.author for r in top.collect()] == ["a", "b"]


def test_topk_works_slice(spark):
    d = dt.date
    rows = [("a", 1, d(2011, 1, 1)), ("a", 2, d(2012, 1, 1)), ("b", 3, d(2011, 5, 1)), ("c", 4, d(2030, 1, 1)),
            ("c", 5, d(2030, 1, 1)), ("c", 6, None)]
    df = spark.createDataFrame(rows, "author string, work_id int, pub_date date")
    got = sorted(r.work_id for r in W.topk_works(df, 1, 2010, 2020).collect())
    assert got == [1, 2]


def test_prune_empty_years(spark):
    df = spark.createDataFrame([(1, 0.0, None, 5.0, 1.0), (2, 0.0, None, None, None)],
                               "id int, `2001` double, `2002` double, `2003` double, `1999` double")
    out = W.prune_empty_years(df, keep=["id"], years=W.year_columns(df.columns, lo=2000))
    assert out.columns == ["id", "2003"]


def test_row_sum_and_target(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "id int, `2001` double, `2002` double")
    got = df.select("id", W.row_sum_years(df, ["2001", "2002"]).alias("s"), W.binary_target("2001").alias("t")).collect()
    assert [(r.id, r.s, r.t) for r in got] == [(1, 1.0, True), (2, 0.0, False)]


def test_dedup_keep_first(spark):
    d = dt.date(2010, 1, 1)
    df = spark.createDataFrame([("X", 7, d), ("X", 3, d), ("Y", 1, d)], "inventor string, patent int, filing_date date")
    got = sorted(tuple(r) for r in W.dedup_keep_first(df, ["inventor", "filing_date"], "patent").collect())
    assert got == [("X", d, 3), ("Y", d, 1)]


def test_project_existing_and_union(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out, missing = W.project_existing(df, ["b", "zz", "a"])
    assert out.columns == ["b", "a"] and missing == ["zz"]
    u = W.union_files([df, spark.createDataFrame([(5,)], "c int")])
    assert sorted(u.columns) == ["a", "b", "c"] and u.count() == 2


def test_input_order_for_any_splits(spark, tmp_dir):
    from pyspark.sql import functions as F
    for i in range(3):
        with open(f"{tmp_dir}/part-{i}.txt", "w") as f:
            f.write("".join(f"{(7 * i + j * j) % 23}\n" for j in range(40 + 10 * i)))
    lines = [line.strip() for i in range(3) for line in open(f"{tmp_dir}/part-{i}.txt")]
    first = {v: lines.index(v) for v in lines}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("16", "100", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = W.input_order(spark.read.text(tmp_dir))
            assert [r.value for r in rows.orderBy("input_row").collect()] == lines
            assert sorted(r.input_row for r in rows.collect()) == list(range(len(lines)))
            assert [tuple(r) for r in W.distinct_first_seen(rows, "value", "input_row").collect()] == sorted(first.items(), key=lambda x: x[1])
            counts = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("input_row").alias("seen"))
            want = sorted(first, key=lambda v: (-lines.count(v), first[v]))[:9]
            assert [r.value for r in W.topk_authors(counts, 9, "value", "n", "seen").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_year_matrix_tasks_follow_the_rows(spark, tmp_dir, monkeypatch):
    import datetime

    from citeflow.plans import bindings as B
    rows = [(i // 3, i % 5, float(i % 7), datetime.datetime(1995 + i % 4, 1, 2) if i % 11 else None) for i in range(900)] + [(None, 1, 2.0, None), (1, 1, None, datetime.datetime(1996, 1, 1))]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_dir}/lineitem.parquet")
    key = lambda r: tuple(str(x) for x in r)
    few = B.year_matrix(spark, tmp_dir)
    cells = B.citation_cells(spark, tmp_dir)
    want, want_cells = sorted(map(key, few.collect())), sorted(map(key, cells.collect()))
    assert few.columns == ["work_id", "author", "1995", "1996", "1997", "1998"]
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    many = B.year_matrix(spark, tmp_dir)
    assert many.rdd.getNumPartitions() == 10 and B.citation_cells(spark, tmp_dir).rdd.getNumPartitions() == 10
    assert sorted(map(key, many.collect())) == want
    assert sorted(map(key, B.citation_cells(spark, tmp_dir).collect())) == want_cells
