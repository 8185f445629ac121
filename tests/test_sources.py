import os

from citeflow.sources import exports as X

HEADER = ",".join(X.CURATED_FIXED_COLUMNS) + ",2020"


def write(path, name, text, enc="utf-8"):
    with open(os.path.join(path, name), "w", encoding=enc, newline="") as f:
        f.write(text)


def test_file_audit(spark, tmp_dir):
    good = HEADER + "\nT1,A,1,,S,2020,1,,,3,1.0,3\n"
    write(tmp_dir, "good file.txt", good)
    write(tmp_dir, "short.txt", HEADER + "\nT1,A,1\n")
    write(tmp_dir, "long.txt", HEADER + "\nT1,A,1,,S,2020,1,,,3,1.0,3,9,9\n")
    write(tmp_dir, "quoted.txt", HEADER + '\n"T, with comma",A,1,,S,2020,1,,,3,1.0,3\n')
    write(tmp_dir, "empty.txt", "")
    write(tmp_dir, "ignored.csv", "x\n1,2,3,4,5,6,7,8,9,10,11,12,13,14,15\n")
    got = {os.path.basename(r.file): r.bad for r in X.file_audit(spark, tmp_dir).collect()}
    assert got == {"good%20file.txt": False, "short.txt": False, "long.txt": True, "quoted.txt": False, "empty.txt": True}
    counts = {r.outcome: r.files for r in X.file_outcome_counts(X.file_audit(spark, tmp_dir)).collect()}
    assert counts == {"ok": 3, "bad": 2}


def raw_line(vals):
    return ",".join('"' + v + '"' for v in vals)


def raw_text(cols, rows, name="Some Author"):
    lines = [raw_line(cols), *[raw_line([r.get(c, "") for c in cols]) for r in rows]]
    return f"\ufeff{name} (Author)\r\nTimespan: 1900-2024. Indexes: A, B.\r\n\r\n" + "\r\n".join(lines) + "\r\n"


def test_audit_headers_and_long_lines(spark, tmp_dir):
    write(tmp_dir, "title row.txt", HEADER + "\nTitle insurance,A,1,,S,2020,1,,,3,1.0,3,9,9,9\n")
    write(tmp_dir, "wide.txt", HEADER + '\n"' + "x, " * 350_000 + '",A,1,,S,2020,1,,,3,1.0,3\n')
    write(tmp_dir, "no header.txt", "A,B\n1,2\n")
    got = {os.path.basename(r.file): r.bad for r in X.file_audit(spark, tmp_dir).collect()}
    assert got == {"title%20row.txt": True, "wide.txt": False, "no%20header.txt": True}
    assert X.file_audit(spark, tmp_dir + "/missing").count() == 0 and X.file_audit(spark, tmp_dir, glob="*.none").count() == 0


def test_raw_rows_are_all_kept(spark, tmp_dir):
    """Blank citation fields, quoted line breaks, a later year, 300 years, short rows."""
    years = [str(y) for y in range(1800, 2100)]
    cols = X.RAW_NAMED_COLUMNS + years
    rows = [{"Title": "A title, with comma", "Authors": "X, A; Y, B", "Total Citations": "5", "2023": "5", "2025": "2", "1801": "1"},
            {"Title": "no citations field", "Authors": "X"}, {"Title": "two\nlines", "Authors": "Z", "Total Citations": "0", "2023": "0"}]
    write(tmp_dir, "PEREZ LOPEZ JUAN.txt", raw_text(cols, rows) + '"short","A"\r\n')
    write(tmp_dir, "NO EXT COPY.csv", raw_text(cols, rows))
    os.makedirs(tmp_dir + "/nested")
    write(tmp_dir + "/nested", "deep.txt", raw_text(cols, rows))
    raw = X.scan_raw_export(spark, tmp_dir)
    got = {r.title: r for r in raw.collect()}
    assert set(got) == {"A title, with comma", "no citations field", "two\nlines", "short"}
    assert {r.author for r in got.values()} == {"PEREZ LOPEZ JUAN"} and len(got["two\nlines"].cells) == 300
    assert got["A title, with comma"].cells["2025"] == "2" and X.rejected_rows(spark, tmp_dir).count() == 0
    cur = {r.title: r for r in X.curate_raw(raw).collect()}
    assert set(cur) == set(got) and cur["A title, with comma"].cells == {"2023": 5.0, "2025": 2.0, "1801": 1.0}
    assert cur["no citations field"].cells == {} and cur["A title, with comma"].corporate_authors == 2
    long = sorted((r.title, r.year, r.cites) for r in X.citations(X.curate_raw(raw)).collect())
    assert long == [("A title, with comma", 1801, 1.0), ("A title, with comma", 2023, 5.0), ("A title, with comma", 2025, 2.0)]
    assert X.scan_raw_export(spark, tmp_dir, recursive=True).count() == 7


def test_missing_and_empty_folders(spark, tmp_dir):
    assert X.scan_raw_export(spark, tmp_dir + "/missing").count() == 0
    assert X.scan_raw_export(spark, tmp_dir).count() == 0 and X.scan_curated(spark, tmp_dir).count() == 0


def test_scan_curated_different_headers(spark, tmp_dir):
    write(tmp_dir, "A.txt", ",".join(X.CURATED_FIXED_COLUMNS) + ",2019,2021\nT1,A,2,,S,2020,1,,,7,1.0,3,4\n")
    write(tmp_dir, "B.txt", ",".join(X.CURATED_FIXED_COLUMNS) + ",2005\nT2,B,1,,S,2005,1,,,1,1.0,1\n")
    years = ",".join(str(y) for y in range(1700, 2000))
    write(tmp_dir, "C.txt", ",".join(X.CURATED_FIXED_COLUMNS) + "," + years + "\nT3,C,1,,S,2005,1,,,1,1.0," + ",".join(["2"] * 300) + "\n")
    cells = X.citations(X.scan_curated(spark, tmp_dir)).collect()
    got = sorted((r.author, r.title, r.year, r.cites) for r in cells if r.author != "C")
    assert got == [("A", "T1", 2019, 3.0), ("A", "T1", 2021, 4.0), ("B", "T2", 2005, 1.0)]
    assert sum(r.author == "C" for r in cells) == 300


def test_tolerant_scan_skips_junk(spark, tmp_dir):
    write(tmp_dir, "junk.txt", "no header here\n\x00\x01 binary-ish\n")
    with open(os.path.join(tmp_dir, "broken.txt.gz"), "wb") as f:
        f.write(b"\x1f\x8b\x08\x00 not a gzip body")
    assert X.scan_raw_export(spark, tmp_dir, glob="*.txt*").count() == 0
    rejected = X.rejected_rows(spark, tmp_dir).collect()
    assert len(rejected) == 2 and {r.author for r in rejected} == {"junk"}


def test_publications_and_patents_tables(spark, tmp_dir):
    write(tmp_dir, "pubs.csv", 'Title,Authors,Publication Date,Total Citations,2019,2031\n"two\nlines", Ñu ,01/02/2019,,1,7\n')
    write(tmp_dir, "pats.csv", "Inventor,Patent,Filing Date\n Núñez ,P1,15/03/2010\n", "latin-1")
    pub = X.scan_publications_csv(spark, tmp_dir + "/pubs.csv").collect()[0]
    assert (pub.author, pub.title, pub.total_citations, pub.cells) == ("Ñu", "two\nlines", None, {"2019": "1", "2031": "7"})
    pat = X.scan_patents_csv(spark, tmp_dir + "/pats.csv").collect()[0]
    assert (pat.inventor, pat.patent, str(pat.filing_date)) == ("NUNEZ", "P1", "2010-03-15")


def test_writers_split_large_authors(spark, tmp_dir):
    rows = [("BIG", f"T{i}", float(i % 3)) for i in range(9)] + [("small", "S1", 1.0)]
    works = spark.createDataFrame(rows, "author string, title string, total_citations double")
    raw_dir = os.path.join(tmp_dir, "raw")
    X.write_raw_exports(works, raw_dir, max_rows_per_file=4)
    files = [os.path.join(r, f) for r, _, fs in os.walk(raw_dir) for f in fs if f.endswith(".txt")]
    assert len([f for f in files if "author=BIG" in f]) == 3
    back = X.scan_raw_export(spark, raw_dir, recursive=True)
    assert sorted((r.author, r.title) for r in back.collect()) == sorted((a, t) for a, t, _ in rows)
    cur = spark.createDataFrame([(a, t, {"2020": c}) for a, t, c in rows], "author string, title string, cells map<string,double>")
    cur_dir = os.path.join(tmp_dir, "cur")
    X.write_curated(cur, cur_dir, max_rows_per_file=4)
    got = sorted((r.author, r.title, float(r.cells["2020"])) for r in X.scan_curated(spark, cur_dir, recursive=True).collect())
    assert got == sorted(rows)
    assert all(not r.bad for r in X.file_audit(spark, cur_dir, recursive=True).collect())


def test_records_span_lines_and_splits(spark, tmp_dir):
    """Quoted line breaks, doubled quotes and a junk line of many commas; the file is read in splits of a few bytes."""
    import csv
    import io
    import random
    r = random.Random(1)
    rows = [["Title", "Authors", "2020"]]
    for i in range(120):
        rows.append([r.choice(['plain', 'one, two,\nthree, four, five', 'say "hi"', '"', 'a\n\n\nb\n"c"', '', f't{i}']) + str(i), r.choice(["A; B", ""]), str(i % 5)])
    rows.insert(50, [""] * 400 + ["x"])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    with open(os.path.join(tmp_dir, "one.txt"), "w", encoding="utf-8") as f:
        f.write("﻿" + out.getvalue())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("64", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = [[x or "" for x in v.v] for v in X._records(spark, tmp_dir, "*.txt", "UTF-8", True, False, True).collect()]
            assert sorted(got) == sorted(rows)
            scan = X.scan_export(spark, tmp_dir).collect()
            assert len(scan) == 120 and all(set(x.rec) == {"Title", "Authors", "2020"} for x in scan)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_audit_counts_records(spark, tmp_dir):
    files = {"breaks.txt": 'Title,Authors\n"one, two,\nthree, four, five",A\n', "long.txt": 'Title,Authors\n"a\nb",A,\n',
             "empty.txt": "", "año 1+2.txt": "Title,Authors\nx,A\n"}
    for name, text in files.items():
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as f:
            f.write(text)
    got = sorted((os.path.basename(r.file), r.bad) for r in X.file_audit(spark, tmp_dir).collect())
    assert not dict(got)["breaks.txt"] and dict(got)["long.txt"] and dict(got)["empty.txt"] and sorted(b for _, b in got) == [False, False, True, True]


def test_failing_files_are_listed_with_the_reason(spark, tmp_dir):
    import bz2
    import gzip
    good = ("Title,Authors\n" + "a b,c\n" * 5).encode()
    files = {"good.txt": good, "good.txt.gz": gzip.compress(good) + gzip.compress(b"x,y\n"), "good.txt.bz2": bz2.compress(good),
             "cut.txt.gz": gzip.compress(good * 200)[:-9], "cut.txt.bz2": bz2.compress(good)[:-5], "broken.txt.gz": b"\x1f\x8b\x08\x00 no archive",
             "zero.txt": b"", "blank.txt": b"\n\n", "junk 1+2.txt": b"no header\n", "latin.txt": "Title,Authors\nAño,A\n".encode("latin-1"),
             "long.txt": good + b"a,b,c\n", "quoted.txt": b'Title,Authors\n"a,\nb",c\n'}
    for name, data in files.items():
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(data)
    got = {r.author: r.reason for r in X.file_failures(spark, tmp_dir, glob="*.txt*").collect()}
    archives = {a for a, r in got.items() if r.startswith("archive: ")}
    assert archives == {"cut.txt", "broken.txt"}
    rest = {a: r for a, r in got.items() if a not in archives}
    assert rest == {"zero": "no records", "blank": "no records", "junk 1+2": "no header", "latin": "not text in UTF-8",
                    "long": "a record has 3 fields, the header 2"}
    assert X.file_failures(spark, tmp_dir + "/missing").count() == 0 and X.file_failures(spark, tmp_dir, glob="*.none").count() == 0
    latin = {r.author: r.reason for r in X.file_failures(spark, tmp_dir, glob="latin*", encoding="ISO-8859-1").collect()}
    assert latin == {}


def test_archive_errors():
    import bz2
    import gzip
    data = b"some text " * 40_000
    for ending, pack in ((".gz", gzip.compress), (".bz2", bz2.compress)):
        packed = pack(data)
        assert X.archive_error(ending, packed) is None and X.archive_error(ending, packed, 1000) is None
        assert X.archive_error(ending, packed + pack(b"x")) is None
        assert X.archive_error(ending, packed[:-12]) and X.archive_error(ending, b"no archive at all")


def test_files_are_written_as_spark_names_their_folders(spark, tmp_dir):
    import os
    names = ["A B", "x/y:z=1", "50%", "Ñandú", 'q"[1]', None]
    rows = [(a, n, o, None, f"{a}-{n}-{o}é") for a in names for n in (0, 1) for o in (1, 0)]
    df = spark.createDataFrame(rows, "author string, file_no int, _o int, _t string, value string")
    X._write_files(df, f"{tmp_dir}/mine", "\r\n")
    df.select("author", "file_no", "value").write.partitionBy("author", "file_no").text(f"{tmp_dir}/spark")
    folders = lambda at: {os.path.relpath(p, at) for p, _, f in os.walk(at) if any(x.endswith(".txt") for x in f)}
    assert folders(f"{tmp_dir}/mine") == folders(f"{tmp_dir}/spark") and len(folders(f"{tmp_dir}/mine")) == 12
    with open(f"{tmp_dir}/mine/author=A B/file_no=1/part-00000.txt", "rb") as f:
        assert f.read() == "A B-1-0é\r\nA B-1-1é\r\n".encode()
    assert not [x for _, _, f in os.walk(f"{tmp_dir}/mine") for x in f if x.endswith(".crc") or x.startswith(".")]
    X._write_files(df.limit(0), f"{tmp_dir}/mine")  # overwrites
    assert not folders(f"{tmp_dir}/mine") and os.path.isdir(f"{tmp_dir}/mine")


def test_folders_are_listed_by_a_bounded_number_of_tasks(spark):
    was = spark.conf.get(X.LISTING, None)
    assert X._listed(spark, lambda: spark.conf.get(X.LISTING)) == str(4 * spark.sparkContext.defaultParallelism)
    assert spark.conf.get(X.LISTING, None) == was


def test_files_read_by_tasks_are_those_of_sparks_reader(spark, tmp_dir, monkeypatch):
    """The same records, names and listing, whoever opens the files: odd names, line ends, quotes, marks, bytes; archives and large files too."""
    import gzip
    import os
    import random
    r = random.Random(3)
    odd = [b"", b"\n", b'Title,Authors\r\n"a\nb",c\r\n', b'\xef\xbb\xbfTitle,Authors\n\xef\xbb\xbfx,"y""z"\n', b'Title,Authors\nx,"open\nto the end', b"a,,\"\",\"\"\"\"\rb\n\n c ",
           "Título,Ñ\n \"q\" ,1\x85,\"a\"b\" \n".encode(), "Año,A\nx,y\n".encode("latin-1"), b'""x"",\t,"\n",z\r\r\n"']
    odd += ["".join(r.choice('ab",\n\r "') for _ in range(r.randrange(60))).encode() for _ in range(40)]
    names = ["a b.txt", "100%+#?.txt", "ñ{1}[2].txt", "author=Ñ 1/x.txt", "_hidden/x.txt", ".x/y.txt", "_a=1/deep/er/z.txt", "x.csv", "big/big.txt"]
    names += [f"d{i % 5}/f{i}.txt" for i in range(len(odd) - len(names))]
    for name, data in [*zip(names, odd), ("p/packed.txt.gz", gzip.compress(odd[2]))]:
        os.makedirs(os.path.dirname(f"{tmp_dir}/{name}"), exist_ok=True)
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(data)
    for glob in ("*.txt", "*.txt*", ""):
        for encoding in ("UTF-8", "ISO-8859-1"):
            for multi_line in (True, False):
                args = (spark, tmp_dir, glob, encoding, True, True, multi_line)
                key = lambda rows: sorted((x.file, [str((v is None, v)) for v in x.v]) for x in rows)
                want = key(X._records_by_reader(*args).collect())
                assert key(X._records(*args).collect()) == want
    monkeypatch.setattr(X, "WHOLE_BYTES", 20)
    args = (spark, tmp_dir, "*.txt*", "UTF-8", True, True, True)
    assert key(X._records(*args).collect()) == key(X._records_by_reader(*args).collect())
    listed = sorted(x.file for x in X.list_files(spark, tmp_dir, "*.txt", True).collect())
    assert listed == sorted(X._reader(spark, "*.txt", True, True).text(tmp_dir).inputFiles()) and len(listed) > 40
