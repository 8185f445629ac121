"""Citation-export files: S1-S10 and P13.

Raw exports: preamble lines, a blank line, a quoted header, quoted rows. Curated files: plain CSV with a header that
differs per file (fixed columns and the years the author has non-zero cells in). Both are read with Spark's CSV reader
over all files of a folder at once; names and years come from each file's own header, and a row is one work: its named
fields, and its year cells in a map. ``citations`` turns the maps into long rows.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.functions import scalars as S
from citeflow.session import cut_lineage, map_in_arrow

# Column layout of the export format.
RAW_NAMED_COLUMNS = [
    "Title", "Authors", "Corporate Authors", "Editors", "Book Editors", "Source Title", "Publication Date",
    "Publication Year", "Volume", "Issue", "Part Number", "Supplement", "Special Issue", "Beginning Page",
    "Ending Page", "Article Number", "DOI", "Conference Title", "Conference Date", "Total Citations",
    "Average per Year",
]
CURATED_FIXED_COLUMNS = [
    "Title", "Authors", "Corporate Authors", "Book Editors", "Source Title", "Publication Date", "Volume",
    "Conference Title", "Conference Date", "Total Citations", "Average per Year",
]
DROPPED_BY_CURATION = [c for c in RAW_NAMED_COLUMNS if c not in CURATED_FIXED_COLUMNS]


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def author_from_file(path: Column) -> Column:
    """Author := file name without extension. Files written by Spark sit
    in Hive-style ``author=<value>/`` folders; that value wins when present.
    Names arrive URL-escaped (spaces as %20), so '+' is protected, then decoded."""
    part = F.regexp_extract(path, r"/author=([^/]+)/", 1)
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    raw = F.when(part != "", part).otherwise(stem)
    return F.url_decode(F.regexp_replace(raw, r"\+", "%2B"))


def _existing(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The paths that are there: a folder that does not exist holds no files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in [path] if isinstance(path, str) else path:
        q = jvm.org.apache.hadoop.fs.Path(p)
        if q.getFileSystem(conf).exists(q):
            out.append(p)
    return out


#: Spark's number of tasks that list folders (10,000 if not set: one or two folders a task, whose start costs more than they do).
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, read):
    """``read()``, which lists files when it is called, with a few listing tasks a core in place of one a folder."""
    was = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return read()
    finally:
        spark.conf.unset(LISTING) if was is None else spark.conf.set(LISTING, was)


def _reader(spark: SparkSession, glob: str, tolerant: bool, recursive: bool):
    r = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if tolerant:
        r = r.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return r


#: One field of a CSV record and the comma after it (a comma is appended to the record); possessive, so linear in the record.
FIELD = r'("(?:[^"]++|"")*+"[^,]*+|[^,]*+),'


def split_record(record: Column) -> Column:
    """The fields of a CSV record as an array, however many there are: an empty field is null, a quoted empty one ``\'\'``."""
    raw = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(FIELD), F.lit(1))
    plain = lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x == "", F.lit(None)).when(x.startswith('"'), plain(x)).otherwise(x))


def whole_records(lines: DataFrame) -> DataFrame:
    """Lines (file, start of their split, at: ascending in a split, line) -> records (file, record): a line that begins inside
    double quotes belongs to the record before it.

    Any number of tasks reads a file, each a split of it: the parity of the quotes of a split is a sum, the parity before a split is
    a running sum over one row a split, and inside a split a running sum over its lines. A record that goes on in
    the next splits is named by the split and number it began with. Only records of several lines are gathered.
    """
    lines = cut_lineage(lines.withColumn("q", F.length("line") - F.length(F.translate("line", '"', ""))), "lines")
    earlier = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "start").agg(F.sum("q").alias("q")).withColumn(
        "odd", F.coalesce(F.sum("q").over(earlier("file").orderBy("start")), F.lit(0)) % 2).drop("q")
    inside = lines.join(splits, ["file", "start"]).withColumn(
        "begins", (F.col("odd") + F.coalesce(F.sum("q").over(earlier("file", "start").orderBy("at")), F.lit(0))) % 2 == 0)
    upto = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut_lineage(inside.withColumn("nr", F.sum(F.col("begins").cast("long")).over(upto)).drop("odd", "q"), "numbered")
    # lines before the first beginning of a split go on with the last record of the nearest split that has one
    last = numbered.groupBy("file", "start").agg(F.max("nr").alias("nr"))
    owner = F.last(F.when(F.col("nr") > 0, F.struct(F.col("start").alias("s"), F.col("nr").alias("r"))), ignorenulls=True)
    owners = last.select("file", "start", owner.over(earlier("file").orderBy("start")).alias("owner"))
    named = numbered.join(owners, ["file", "start"]).select(
        "file", F.when(F.col("nr") > 0, F.col("start")).otherwise(F.col("owner.s")).alias("s"),
        F.when(F.col("nr") > 0, F.col("nr")).otherwise(F.col("owner.r")).alias("r"), "start", "at", "line", "begins")
    more = named.where(~F.col("begins")).select("file", "s", "r").distinct()
    single = named.join(more, ["file", "s", "r"], "left_anti").select("file", F.col("line").alias("record"))
    several = (named.join(more, ["file", "s", "r"], "left_semi").groupBy("file", "s", "r")
               .agg(F.array_sort(F.collect_list(F.struct("start", "at", "line"))).alias("l"))
               .select("file", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("record")))
    return single.unionByName(several)


#: Files of a mounted file system are read whole by a task up to so many bytes; a task takes about so many bytes and files.
WHOLE_BYTES, TASK_BYTES, TASK_FILES = 64 << 20, 32 << 20, 4096
#: Name endings that Spark's reader unpacks; such files are left to it.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".lzo", ".xz")
_FIELD, _QUOTES = re.compile(FIELD), re.compile('^"|"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z)')
#: What Java's URIs escape in a path.
_ODD = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]""")


def fields_of(record: str) -> list[str | None]:
    """``split_record`` of one record."""
    return [(None if not x else _QUOTES.sub("", x).replace('""', '"') if x[0] == '"' else x) for x in _FIELD.findall(record + ",")]


def records_of(data: bytes, encoding: str, multi_line: bool) -> Iterator[str]:
    """The records of a whole file, as the line reader and ``whole_records`` give them."""
    if data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    lines = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    if not lines[-1]:
        lines.pop()
    held: list[str] = []
    odd = False
    for raw in lines:
        line = raw.decode(encoding, "replace")
        line = line[1:] if line.startswith("\ufeff") else line
        held.append(line)
        odd ^= multi_line and line.count('"') % 2 == 1
        if not odd:
            yield held[0] if len(held) == 1 else "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def mounted_files(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame | None:
    """(file: as Spark names it, path, size) of the files below ``paths`` whose name matches, by tasks that each list some of the
    folders; None if a path is not on a mounted file system (scheme ``file``) or the pattern is one of Hadoop's own."""
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = [jvm.Path(p) for p in paths]
    if any(q.getFileSystem(conf).getUri().getScheme() != "file" for q in found) or set(glob or "") & set("{}[]\\"):
        return None
    roots = [os.path.abspath(q.toUri().getPath()) for q in found]
    # a path's own entries are named here, as by Spark's listing; what is below is listed by tasks
    tops = [x for r in roots for x in ([e.path for e in os.scandir(r) if not _hidden(e.name)] if os.path.isdir(r) else [r])]
    matches = re.compile(fnmatch.translate(glob or "*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, todo = [], batch.column(0).to_pylist()[::-1]
            while todo:
                top = todo.pop()
                try:
                    if os.path.isdir(top):
                        todo += [e.path for e in os.scandir(top) if not _hidden(e.name)]
                    elif matches.match(os.path.basename(top)):
                        rows.append(("file:" + _ODD.sub(lambda m: f"%{ord(m[0]):02X}", top), top, os.stat(top).st_size))
                except FileNotFoundError:  # gone since
                    pass
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip(
                (("file", pa.string()), ("path", pa.string()), ("size", pa.int64())), zip(*rows) if rows else ((), (), ()))})

    some = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-len(tops) // 512)))
    names = spark.createDataFrame(pa.table({"path": pa.array(tops, pa.string())})).repartition(some)
    return cut_lineage(map_in_arrow(names, run, "file string, path string, size long"), "files")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _own_files(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """Of ``mounted_files``: those that tasks open themselves, by how many tasks, and the paths of the others."""
    ours = (F.col("size") <= WHOLE_BYTES) & ~F.lower("path").rlike("(" + "|".join(re.escape(e) for e in PACKED) + ")$")
    own = files.where(ours)
    size, n = own.agg(F.sum("size"), F.count("*")).first()
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-(size or 0) // (TASK_BYTES * cores)), -(-n // (TASK_FILES * cores)))
    return own, max(1, min(n, tasks)), ["file:" + r["path"] for r in files.where(~ours).where("size > 0").select("path").collect()]


def _whole_files(files: DataFrame, tasks: int, encoding: str, tolerant: bool, multi_line: bool) -> DataFrame:
    """file, v of the records of files that tasks open themselves (Spark's reader takes milliseconds a file)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, size = [], [], 0

        def made():
            return pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "v": pa.array(rows, pa.list_(pa.string()))})

        for batch in batches:
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    if tolerant:
                        continue
                    raise
                for record in records_of(data, encoding, multi_line):
                    names.append(file)
                    rows.append(fields_of(record))
                    size += len(record) + len(file)
                    if size > 4 << 20:
                        yield made()
                        names, rows, size = [], [], 0
        if rows:
            yield made()

    return map_in_arrow(files.select("file", "path").repartition(tasks), run, "file string, v array<string>")


def _records(spark: SparkSession, path: str | Sequence[str], glob: str, encoding: str, tolerant: bool, recursive: bool,
             multi_line: bool) -> DataFrame:
    """Every CSV record of the files: file, v (all its fields). One scan; no schema is as wide as the widest line. On a mounted file
    system tasks open plain files themselves; archives, files of over ``WHOLE_BYTES`` (read in splits) and other file systems
    are Spark's reader's."""
    paths = _existing(spark, path)
    files = mounted_files(spark, paths, glob) if paths and recursive and encoding.upper() in ("UTF-8", "ISO-8859-1") else None
    if files is None:
        return _records_by_reader(spark, path, glob, encoding, tolerant, recursive, multi_line)
    own, tasks, rest = _own_files(spark, files)
    out = _whole_files(own, tasks, encoding, tolerant, multi_line)
    if rest:
        out = out.unionByName(_records_by_reader(spark, rest, "", encoding, tolerant, recursive, multi_line, exact=True))
    return out


def _records_by_reader(spark: SparkSession, path: str | Sequence[str], glob: str, encoding: str, tolerant: bool, recursive: bool,
                       multi_line: bool, exact: bool = False) -> DataFrame:
    """``_records`` by Spark's text reader; paths that are ``exact`` are no patterns."""
    empty = spark.createDataFrame([], "file string, v array<string>")
    paths = _existing(spark, path)
    if not paths:
        return empty
    try:
        text = _listed(spark, lambda: _reader(spark, glob, tolerant, recursive).option("__globPaths__", not exact).text(paths))
    except AnalysisException:  # no file matches
        return empty
    decoded = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("at"), F.regexp_replace(decoded, "^\ufeff", "").alias("line"))
    whole = whole_records(lines) if multi_line else lines.select("file", F.col("line").alias("record"))
    return whole.select("file", split_record(F.col("record")).alias("v"))


def _fields(spark: SparkSession, path: str | Sequence[str], glob: str, encoding: str, tolerant: bool, recursive: bool,
            multi_line: bool) -> DataFrame:
    """``_records`` with n, the number of fields up to the last one that is set."""
    n = F.coalesce(F.array_max(F.transform("v", lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    return _records(spark, path, glob, encoding, tolerant, recursive, multi_line).withColumn("n", n)


def _kinds(fields: DataFrame, header_fields: Sequence[str]) -> DataFrame:
    """Add what a record is: blank, header, preamble (raw exports) or row; and its file's header, if it has one."""
    blank = F.size(F.filter("v", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")) == 0
    header = F.lit(True)
    for i, h in enumerate(header_fields):
        header = header & F.get("v", F.lit(i)).eqNullSafe(F.lit(h))
    said = F.array_join(F.slice("v", 1, F.greatest("n", F.lit(1))), ",")
    preamble = (F.col("n") <= 8) & (said.endswith(" (Author)") | F.get("v", F.lit(0)).startswith("Timespan:"))
    kind = F.when(blank, "blank").when(header, "header").when(preamble, "preamble").otherwise("row")
    marked = fields.withColumn("kind", kind)
    headers = (marked.where("kind = 'header'").groupBy("file")
               .agg(F.max_by(F.slice("v", 1, F.col("n")), "n").alias("h")))
    return marked.join(headers, "file", "left")


def scan_export(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", encoding: str = "UTF-8", tolerant: bool = True,
                recursive: bool = False, multi_line: bool = True, header_fields: Sequence[str] = ("Title", "Authors")) -> DataFrame:
    """All rows of headered export files, one per work: author (file name), file, rec (column name -> field).

    Fields are matched by their file's header; a short row has nulls at its end. ``multi_line`` allows line breaks
    inside quotes (a file is then read by one task). A folder that is missing or holds no file gives an empty table.
    """
    rows = _kinds(_fields(spark, path, glob, encoding, tolerant, recursive, multi_line), header_fields)
    rows = rows.where((F.col("kind") == "row") & F.col("h").isNotNull() & (F.col("n") <= F.size("h")))
    return rows.select(author_from_file(F.col("file")).alias("author"), "file",
                       F.map_from_arrays("h", F.slice(F.concat("v", F.array_repeat(F.lit(None).cast("string"), F.greatest(F.size("h") - F.size("v"), F.lit(0)))), 1, F.size("h"))).alias("rec"))


def rejected_rows(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", encoding: str = "UTF-8",
                  recursive: bool = False, header_fields: Sequence[str] = ("Title", "Authors")) -> DataFrame:
    """S8's rejected rows: records longer than their file's header, and all records of files without one."""
    rows = _kinds(_fields(spark, path, glob, encoding, True, recursive, True), header_fields)
    bad = (F.col("kind") == "row") & (F.col("h").isNull() | (F.col("n") > F.size("h")))
    return rows.where(bad).select("file", author_from_file(F.col("file")).alias("author"), F.get("v", F.lit(0)).alias("first_field"))


# File name endings of archives that both Spark's text reader and Python's library unpack.
ARCHIVES = {".gz": gzip.open, ".bz2": bz2.open}


def archive_error(ending: str, data: bytes, step: int = 1 << 20) -> str | None:
    """Why an archive can not be unpacked, or None. It is unpacked in steps and nothing is kept."""
    try:
        with io.BytesIO(data) as packed, ARCHIVES[ending](packed) as unpacked:
            while unpacked.read(step):
                pass
    except (OSError, EOFError, zlib.error) as e:
        return str(e)
    return None


def broken_archives(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt*", recursive: bool = False) -> DataFrame:
    """(file, reason) of the archives among the files that can not be unpacked. A file is one row of Spark's binary reader (at
    most 2 GB packed, its bound) and is tested in one task, as an archive is also read by one; only files with the name of an archive are opened."""
    empty = spark.createDataFrame([], "file string, reason string")
    paths = _existing(spark, path)
    if not paths:
        return empty
    ends = ",".join(e[1:] for e in ARCHIVES)
    files = mounted_files(spark, paths, glob) if recursive else None
    if files is not None:
        ours = [r["path"] for r in files.where(F.col("path").rlike("(" + "|".join(re.escape(e) for e in ARCHIVES) + ")$")).select("path").collect()]
        if not ours:
            return empty
        found = spark.read.option("__globPaths__", False).format("binaryFile").load(ours)
    else:
        try:
            found = _listed(spark, lambda: _reader(spark, f"*.{{{ends}}}", False, recursive).format("binaryFile").load(paths))
        except AnalysisException:
            return empty
    named = found.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(fnmatch.translate(glob))).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            why = [archive_error(n[n.rindex("."):], batch.column(1)[i].as_py()) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(why, pa.string())], names=["file", "reason"])

    return map_in_arrow(named, run, "file string, reason string").where(F.col("reason").isNotNull())


def _undecoded(spark: SparkSession, path: str | Sequence[str], glob: str, recursive: bool) -> DataFrame:
    """(file) of the files with bytes that are not text in UTF-8."""
    paths = _existing(spark, path)

    def by_reader(paths, glob, exact):
        odd = _listed(spark, lambda: _reader(spark, glob, True, recursive).option("__globPaths__", not exact).text(paths)).where(~F.is_valid_utf8("value"))
        return odd.select(F.col("_metadata.file_path").alias("file")).distinct()

    files = mounted_files(spark, paths, glob) if recursive else None
    if files is None:
        return by_reader(paths, glob, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = []
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        f.read().decode("utf-8")
                except FileNotFoundError:
                    pass
                except UnicodeDecodeError:
                    odd.append(file)
            yield pa.RecordBatch.from_pydict({"file": pa.array(odd, pa.string())})

    own, tasks, rest = _own_files(spark, files)
    out = map_in_arrow(own.select("file", "path").repartition(tasks), run, "file string")
    return out.unionByName(by_reader(rest, "", True)) if rest else out


def file_failures(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", encoding: str = "UTF-8", recursive: bool = False,
                  header_fields: Sequence[str] = ("Title", "Authors")) -> DataFrame:
    """S8's list of files that can not be read whole: file, author, reason (one a file, the first of those below).

    An archive that can not be unpacked (with the error); bytes that are not text of the encoding; no records; no header; a record with more
    fields than the header. Missing folders and folders without such files give an empty table. A scan counts the records of each file, so
    nothing but one row a file is gathered; a file of any size is read in splits.
    """
    files = list_files(spark, path, glob, recursive)
    if files.isEmpty():
        return spark.createDataFrame([], "file string, author string, reason string")
    marked = _kinds(_fields(spark, path, glob, encoding, True, recursive, True), header_fields)
    per = marked.where("kind <> 'blank'").groupBy("file").agg(
        F.max(F.when(F.col("kind") == "row", F.col("n"))).alias("widest"), F.max(F.size("h")).alias("header"))
    bad = broken_archives(spark, path, glob, recursive)
    key = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "^file:/*", "/").alias("_k")
    raw = F.regexp_replace("file", "^file:/*", "/").alias("_k")  # the binary reader's paths are not URL-encoded
    reasons = per.select(key, "widest", "header", F.lit(True).alias("read")).join(bad.select(raw, F.concat(F.lit("archive: "), "reason").alias("broken")), "_k", "full")
    if encoding.upper() == "UTF-8":
        odd = _undecoded(spark, path, glob, recursive)
        reasons = reasons.join(odd.select(key, F.lit("not text in UTF-8").alias("undecoded")), "_k", "left")
    else:
        reasons = reasons.withColumn("undecoded", F.lit(None).cast("string"))
    wide = F.concat(F.lit("a record has "), F.col("widest").cast("string"), F.lit(" fields, the header "), F.col("header").cast("string"))
    reason = F.coalesce("broken", "undecoded", F.when(F.col("read").isNull(), "no records"), F.when(F.col("header").isNull(), "no header"),
                        F.when(F.col("widest") > F.col("header"), wide))
    return (files.select("file", key).join(reasons, "_k", "left").select("file", author_from_file(F.col("file")).alias("author"), reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def _works(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.map_filter("rec", lambda k, v: k.rlike("^[0-9]+$"))
    return records.select("author", "file", *[F.col("rec")[c].alias(snake(c)) for c in columns], cells.alias("cells"))


def scan_raw_export(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", encoding: str = "UTF-8",
                    tolerant: bool = True, recursive: bool = False, multi_line: bool = True) -> DataFrame:
    """S1 (+ S5 encoding, S8 tolerance, S9 extension filter, P13 author): one row a publication, whatever its fields hold.

    Returns author, file, the named columns in snake_case, and ``cells`` (year -> field) for all years of the header.
    """
    return _works(scan_export(spark, path, glob, encoding, tolerant, recursive, multi_line), RAW_NAMED_COLUMNS)


def scan_curated(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", encoding: str = "UTF-8",
                 tolerant: bool = True, recursive: bool = False, multi_line: bool = True) -> DataFrame:
    """A folder of headered CSVs whose headers differ. One row a work, like ``scan_raw_export``."""
    return _works(scan_export(spark, path, glob, encoding, tolerant, recursive, multi_line), CURATED_FIXED_COLUMNS)


def citations(works: DataFrame, keep: Sequence[str] = ("author", "title")) -> DataFrame:
    """Year cells of works as long rows: the kept columns, year, cites (null where a field is no number)."""
    long = works.select(*keep, F.explode("cells").alias("year", "cell"))
    return long.select(*keep, F.col("year").cast("int").alias("year"), F.col("cell").cast("string").try_cast("double").alias("cites"))


def curate_raw(raw: DataFrame) -> DataFrame:
    """Raw works -> curated works, row for row.

    ``corporate_authors`` is the number of names in the raw Authors list; the columns that curation drops are gone;
    ``cells`` keeps the cells that are numbers other than zero (year -> double).
    """
    fixed = [snake(c) for c in CURATED_FIXED_COLUMNS]
    number = F.transform_values("cells", lambda k, v: v.try_cast("double"))
    return raw.select("author", "file", *[F.col(c) for c in fixed if c != "corporate_authors"],
                      S.count_names("authors").alias("corporate_authors"),
                      F.map_filter(number, lambda k, v: F.coalesce(v, F.lit(0.0)) != 0).alias("cells")).select(
                          "author", "file", *fixed, "cells")


# -- publications and patents tables (S3, S4) -------------------------------------------


def _headered(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return (spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))


def scan_publications_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S3: the publications table -> works: author (trimmed ``Authors``), all other named columns in snake_case as text,
    and ``cells`` (year -> field) for the year columns that its header has."""
    df = _headered(spark, path, encoding)
    years = [c for c in df.columns if c.strip().isdigit()]
    named = [c for c in df.columns if c not in years]
    cells = F.create_map(*[x for y in years for x in (F.lit(y.strip()), F.col(f"`{y}`"))]) if years else F.create_map().cast("map<string,string>")
    author = [S.trim_name(F.col("`Authors`")).alias("author")] if "Authors" in named else []
    return df.select(*author, *[F.col(f"`{c}`").alias(snake(c)) for c in named if snake(c) != "author" or not author], cells.alias("cells"))


def scan_patents_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """The patents table: inventor (normalised), patent (text), filing_date (strict ``dd/MM/yyyy``)."""
    df = _headered(spark, path, encoding)
    return df.select(S.normalize_name(S.trim_name("`Inventor`")).alias("inventor"), F.col("`Patent`").alias("patent"),
                     S.strict_dmy_date("`Filing Date`").alias("filing_date"))


# -- audit (S6, S7) ------------------------------------------------------------------


def count_fields(line: Column) -> Column:
    """Fields of a CSV line: commas outside double quotes, and one. Linear in the line."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.translate(bare, ",", "")) + 1


def audit_lines(lines: DataFrame, file_col: str = "file", fields_col: str = "fields",
                header_width: Column | int | None = None, header_col: str | None = None) -> DataFrame:
    """S6 core: a file is bad when a data line has more fields than its header
    (short lines are padded, not errors). The header width is a constant, or
    taken from the file's header lines (``header_col`` true)."""
    if header_col is not None:
        per = lines.groupBy(file_col).agg(
            F.max(F.when(F.col(header_col), F.col(fields_col))).alias("_hw"),
            F.max(F.when(~F.col(header_col), F.col(fields_col))).alias("_mx"))
        bad = F.col("_hw").isNull() | (F.coalesce(F.col("_mx"), F.lit(0)) > F.col("_hw"))
    else:
        hw = header_width if isinstance(header_width, Column) else F.lit(header_width)
        per = lines.groupBy(file_col).agg(F.max(fields_col).alias("_mx"))
        bad = F.col("_mx") > hw
    return per.select(F.col(file_col).alias("file"), bad.alias("bad"))


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file) of every file whose name matches ``glob``, empty ones included: by tasks on a mounted file system, else Spark's own listing, in
    one call. (A scan, also a ``binaryFile`` one, skips files without bytes, so it can not list them.)"""
    paths = _existing(spark, path)
    if not paths:
        return spark.createDataFrame([], "file string")
    files = mounted_files(spark, paths, glob) if recursive else None
    if files is not None:
        return files.select(F.regexp_replace("file", "^file:", "file://").alias("file"))
    try:
        found = _listed(spark, lambda: _reader(spark, glob, True, recursive).text(paths)).inputFiles()
    except AnalysisException:
        found = []
    return spark.createDataFrame([(f,) for f in found], "file string")


def file_audit(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt", header_first: str = "Title", recursive: bool = False,
               encoding: str = "UTF-8") -> DataFrame:
    """S6 on a folder: (file, bad). Empty files and files without a header (a record whose first field is exactly
    ``header_first``) are bad, as are files with a record of more fields than their header. Records, not lines, are counted: a
    line break inside quotes is part of its record."""
    files = list_files(spark, path, glob, recursive)
    if files.isEmpty():
        return files.withColumn("bad", F.lit(True))
    found = _records(spark, path, glob, encoding, True, recursive, True)
    found = found.where(F.size(F.filter("v", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")) > 0)
    sized = found.select("file", F.size("v").alias("fields"), F.get("v", F.lit(0)).eqNullSafe(F.lit(header_first)).alias("is_header"))
    per = audit_lines(sized, "file", "fields", header_col="is_header")
    # both sides are URL-encoded paths; they may differ in the scheme prefix
    key = F.regexp_replace(F.col("file"), "^file:/*", "/")
    return (files.withColumn("_k", key).join(per.withColumn("_k", key).drop("file"), "_k", "left")
            .select("file", F.coalesce(F.col("bad"), F.lit(True)).alias("bad")))


def file_outcome_counts(audit: DataFrame) -> DataFrame:
    """Two rows (outcome, files)."""
    return (audit.groupBy(F.when(F.col("bad"), "bad").otherwise("ok").alias("outcome"))
            .agg(F.count(F.lit(1)).alias("files")))


# -- writers used for round trips (the export shapes) ------------------------------------------


def _q(c: Column) -> Column:
    """Quote a field the export way: "..." with inner quotes doubled."""
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def _file_numbers(df: DataFrame, files_per_author: int | None, max_rows_per_file: int) -> DataFrame:
    """Add ``file_no``: which of its author's files a row goes to. The number
    of files per author is fixed, or ceil(rows / max_rows_per_file) from a
    per-author count (an aggregate joined back by author; AQE splits a hot
    author on the big side), and rows are spread by a hash of the title."""
    if files_per_author:
        nf = F.lit(int(files_per_author))
    else:
        counts = df.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / F.lit(max_rows_per_file)).alias("_nf"))
        df = df.join(counts, "author")
        nf = F.col("_nf")
    out = df.withColumn("file_no", F.pmod(F.xxhash64(F.col("title").cast("string")), nf).cast("int"))
    return out.drop("_nf") if not files_per_author else out


#: What Spark escapes in the folder names of partitions (control characters too), and its name for null and empty values.
_ESCAPED = frozenset('"#%\'*/:=?\\{[]^\x7f' + "".join(map(chr, range(1, 32))))
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_name(value: str | None) -> str:
    """A value as Spark writes it in a partition's folder name."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value) if value else _NO_VALUE


def _write_local(lines: DataFrame, root: str, line_sep: str) -> None:
    """``_write_files`` on a file system that is mounted: each task opens its files itself. Spark's writer starts a process or two
    for the permissions of every file there. A file gets its name when it is whole, so an attempt that fails leaves none."""
    end = line_sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = out = hidden = name = None
        files = 0

        def done():
            if out is not None:
                out.close()
                os.replace(hidden, name)

        for batch in batches:
            for author, number, value in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or (author, number) != now:
                    done()
                    now, files = (author, number), files + 1
                    where = f"{root}/author={folder_name(author)}/file_no={folder_name(None if number is None else str(number))}"
                    try:
                        os.mkdir(where)
                    except OSError:  # no folder of the author yet, or there already
                        os.makedirs(where, exist_ok=True)
                    name, hidden = f"{where}/part-00000.txt", f"{where}/.part-{uuid.uuid4().hex}"
                    out = open(hidden, "wb")
                out.write((value or b"") + end)
        done()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    map_in_arrow(lines.withColumn("value", F.col("value").cast("binary")), run, "files long").agg(F.sum("files")).first()


def _write_files(lines: DataFrame, path: str, line_sep: str = "\n") -> None:
    """One text file per (author, file_no): the derived key guarantees a real
    repartition (no upstream exchange is partitioned by it), so a file's
    lines share one task, in order; Hive-style folders author=/file_no=."""
    spark = lines.sparkSession
    allr = lines.withColumn("_key", F.xxhash64("author", "file_no"))
    dealt = allr.repartition("_key").sortWithinPartitions("author", "file_no", "_o", "_t").select("author", "file_no", "value")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.delete(where, True)
        fs.mkdirs(where)
        _write_local(dealt, where.toUri().getPath(), line_sep)
    else:
        dealt.write.mode("overwrite").option("lineSep", line_sep).partitionBy("author", "file_no").text(path)


def write_raw_exports(works: DataFrame, path: str, files_per_author: int | None = None,
                      max_rows_per_file: int = 100_000, timespan: str = "all years") -> None:
    """Write F-RAW files: one folder per author holding one or more files
    (``files_per_author``, or enough to keep each under ``max_rows_per_file``
    rows, so a huge author is split over several writers), each with its own
    preamble and header. BOM + CRLF as in the shipped exports. ``works`` needs
    ``author`` and named columns in snake_case (missing ones are written
    empty); the year columns are the years that its ``cells`` have."""
    have = set(works.columns)
    years = sorted((r[0] for r in works.select(F.explode(F.map_keys("cells"))).distinct().collect()), key=int) if "cells" in have else []
    named = [F.col(snake(c)) if snake(c) in have else F.lit(None).cast("string") for c in RAW_NAMED_COLUMNS]
    row_line = F.concat_ws(",", *[_q(c) for c in named], *[_q(F.col("cells")[y]) for y in years])
    base = works.select(F.col("author").cast("string").alias("author"), F.col("title").cast("string").alias("title"),
                        row_line.alias("value"))
    rows = cut_lineage(_file_numbers(cut_lineage(base, "export-rows"), files_per_author, max_rows_per_file)  # each is read more than once
                       .select("author", "file_no", F.lit(4).alias("_o"), F.col("title").alias("_t"), "value"), "export-lines")
    keys = rows.select("author", "file_no").distinct()
    header = ",".join(f'"{c}"' for c in [*RAW_NAMED_COLUMNS, *years])
    pre = keys.select("author", "file_no", F.explode(F.array(
        F.struct(F.lit(0).alias("_o"), F.concat(F.lit("\ufeff"), F.col("author"), F.lit(" (Author)")).alias("value")),
        F.struct(F.lit(1).alias("_o"), F.lit(f"Timespan: {timespan}.").alias("value")),
        F.struct(F.lit(2).alias("_o"), F.lit("").alias("value")),
        F.struct(F.lit(3).alias("_o"), F.lit(header).alias("value")))).alias("p")) \
        .select("author", "file_no", F.col("p._o").alias("_o"), F.lit(None).cast("string").alias("_t"),
                F.col("p.value").alias("value"))
    _write_files(rows.unionByName(pre), path, "\r\n")


def write_curated(works: DataFrame, path: str, files_per_author: int | None = None, max_rows_per_file: int = 100_000) -> None:
    """Write F-CUR files from curated works (fixed columns in snake_case, and ``cells``: year -> number): one folder per
    author; the header lists the fixed columns and the years that author has non-zero cells in."""
    works = cut_lineage(works, "curated-works")  # read for the years and for the rows
    have = set(works.columns)
    fixed = [F.col("author") if c == "Authors" else F.col(snake(c)) if snake(c) in have else F.lit(None).cast("string")
             for c in CURATED_FIXED_COLUMNS]
    years = (works.select("author", F.explode("cells").alias("y", "n")).where("n <> 0").groupBy("author")
             .agg(F.array_sort(F.collect_set("y")).alias("years")))
    j = works.join(years, "author", "left").withColumn("years", F.coalesce("years", F.array().cast("array<string>")))

    def csvq(c):
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[",\r\n]'), _q(s)).otherwise(s)
    cells = F.transform("years", lambda y: F.coalesce(F.col("cells")[y].cast("long").cast("string"), F.lit("0")))
    line = F.array_join(F.concat(F.array(*[csvq(c) for c in fixed]), cells), ",")
    lines = cut_lineage(j.select(F.col("author").cast("string").alias("author"), F.col("title").cast("string")
                                 .alias("title"), line.alias("value"), "years"), "curated-lines")
    data = _file_numbers(lines, files_per_author, max_rows_per_file)
    names = F.concat(F.array(*[F.lit(c) for c in CURATED_FIXED_COLUMNS]), F.col("years"))
    hdr = (data.select("author", "file_no", "years").dropDuplicates(["author", "file_no"])
           .select("author", "file_no", F.lit(0).alias("_o"), F.lit(None).cast("string").alias("_t"), F.array_join(names, ",").alias("value")))
    body = data.select("author", "file_no", F.lit(1).alias("_o"), F.col("title").alias("_t"), "value")
    _write_files(body.unionByName(hdr), path)
