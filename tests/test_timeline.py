import datetime as dt

from citeflow.operators import timeline as T


def test_before_after_edges(spark):
    d = dt.date
    pats = spark.createDataFrame([("A", 1, d(2010, 5, 10)), ("A", 2, d(2010, 5, 10)), ("Z", 3, d(2010, 1, 1))],
                                 "inventor string, patent int, filing_date date")
    pubs = spark.createDataFrame([("A", d(2010, 5, 9)), ("A", d(2010, 5, 10)), ("A", d(2010, 5, 11)), ("A", None)],
                                 "author string, pub_date date")
    got = {r.inventor: (r.patent, r.pubs_before, r.pubs_after, r.change) for r in T.before_after_count(pats, pubs).collect()}
    assert got == {"A": (1, 1, 2, 1), "Z": (3, 0, 0, 0)}


def test_before_after_nulls(spark):
    d = dt.date
    pats = spark.createDataFrame([(None, 1, d(2010, 1, 1)), ("A", 2, None), ("A", 3, d(2010, 1, 1)), ("A", 4, d(2001, 1, 1))],
                                 "inventor string, patent int, filing_date date")
    pubs = spark.createDataFrame([(None, d(2009, 1, 1)), ("A", d(2009, 1, 1)), ("A", d(2004, 12, 31))], "author string, pub_date date")
    got = {r.patent: (r.pubs_before, r.pubs_after) for r in T.before_after_count(pats, pubs).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (2, 0), 4: (0, 2)}
    got = {r.patent: (r.pubs_before, r.pubs_after) for r in T.before_after_count(pats, pubs, years=(2005, 2023)).collect()}
    assert got == {1: (0, 0), 3: (1, 0)}


def test_before_after_property(spark):
    import random
    rnd = random.Random(3)
    base = dt.date(2000, 1, 1)
    pats = [(f"a{rnd.randrange(5)}", i, base + dt.timedelta(days=rnd.randrange(100))) for i in range(40)]
    pubs = [(f"a{rnd.randrange(5)}", base + dt.timedelta(days=rnd.randrange(100))) for _ in range(300)]
    out = T.before_after_count(spark.createDataFrame(pats, "inventor string, patent int, filing_date date"),
                               spark.createDataFrame(pubs, "author string, pub_date date"), dedup=False).collect()
    for r in out:
        b = sum(1 for a, p in pubs if a == r.inventor and p < r.filing_date)
        f = sum(1 for a, p in pubs if a == r.inventor and p >= r.filing_date)
        assert (r.pubs_before, r.pubs_after) == (b, f)


def test_outer_join_fill(spark):
    left = spark.createDataFrame([("both", 2), ("works", 1)], "author string, publications long")
    right = spark.createDataFrame([("both", 5), ("patents", 1)], "author string, patents long")
    got = {r.author: (r.publications, r.patents) for r in T.outer_join_fill(left, right, "author").collect()}
    assert got == {"both": (2, 5), "works": (1, 0), "patents": (0, 1)}


def test_ols_trend(spark):
    d = dt.date
    pubs = spark.createDataFrame([("a", d(2000, 1, 1)), ("a", d(2001, 1, 1)), ("a", d(2001, 2, 1)), ("b", d(2000, 1, 1))],
                                 "author string, pub_date date")
    rows = T.ols_trend(pubs).collect()
    assert {r.author for r in rows} == {"a"}
    fit = {r.year: r.fitted for r in rows}
    assert abs(fit[2000] - 1.0) < 1e-9 and abs(fit[2001] - 2.0) < 1e-9
