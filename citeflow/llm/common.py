"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.pretokens import release
from citeflow.session import cut_lineage, drop_stage, scratch_path, shared_dir, write_stage  # noqa: F401  (re-exported)

#: Bytes of text an Arrow step works on before it yields what it has.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, text_at: int, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``step`` bytes of text each (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > step:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors (once a session), so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    where = os.path.join(tempfile.mkdtemp(prefix="citeflow-code-"), "citeflow_code.zip")
    with zipfile.ZipFile(where, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "citeflow")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(where)
    _SHIPPED.add(sc.applicationId)


#: Spark's bound on the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory of this Python worker to the system (Arrow's pool, and the C library's where it can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_arrow(df: DataFrame, fn: Callable, schema, keeps_table: bool = False) -> DataFrame:
    """``mapInArrow``. Python workers are reused: unless the tasks use a table shared by a worker's tasks (``keeps_table``),
    they first let go of the one that an earlier stage may have left in their worker. When a task ends its worker gives
    freed memory back to the system, so that idle workers of a long pipeline do not hold what their last task used. Batches
    are bounded in bytes, unless the session already says how."""
    spark = df.sparkSession
    ship_code(spark)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(STEP_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_table:
            release()
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, text_col: str, out_schema: str, make: Callable[[], Callable], keeps_table: bool = False) -> DataFrame:
    """``mapInArrow`` that hands texts to ``fn(texts) -> list of Arrow arrays``, one array per new column.

    All columns of ``df`` but ``text_col`` are kept; the new columns of ``out_schema`` follow. ``make()`` builds ``fn``
    once per task, so that models and caches are loaded on the executor.
    """
    keep = [c for c in df.columns if c != text_col]
    at = df.columns.index(text_col)
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema, *T.StructType.fromDDL(out_schema)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, at):
                made = fn(part.column(at).to_pylist())
                cols = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=names)

    return map_arrow(df, run, schema, keeps_table)
