"""Session and shared-folder helpers.

Everything in the library takes an existing ``SparkSession``; this module only
builds one for tests, scripts and the bench, and resolves the shared folder
used to cut lineage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "citeflow", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("CITEFLOW_SHUFFLE_PARTITIONS", cpus))
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CITEFLOW_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set on a local master (a bare test session) do we pick a
    local folder; on a cluster that would not be shared, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if not d and cur:
        # the context dir is a uuid subfolder of the configured one
        d = cur.rsplit("/", 1)[0]
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="citeflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not cur:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return f"{shared_dir(spark)}/citeflow/{name}-{uuid.uuid4().hex[:12]}"


def write_stage(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Write a table to the shared folder; returns it re-read, and its path for ``drop_stage``."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop_stage(spark: SparkSession, path: str | None) -> None:
    """Delete one stage that ``write_stage`` wrote and that nothing reads any more."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a table written to the shared folder.

    Survives executor loss like a reliable checkpoint, and unlike
    ``checkpoint()`` the re-read table carries its real file size as
    statistics: a checkpointed plan keeps its origin's size estimate, and in
    an iterative job those estimates multiply across joins level after level
    until the optimizer spends minutes on big-integer arithmetic.
    """
    return write_stage(df, name)[0]


_SHIPPED: set[str] = set()

#: Spark's bound on the bytes of an Arrow batch, and what is set where the session has none.
BATCH_BYTES, STEP_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def map_in_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors first (once a session), so that Python tasks can import it. Batches
    are bounded in bytes (rows may be blocks of a thousand), unless the session already says how."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(STEP_BYTES))
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        where = os.path.join(tempfile.mkdtemp(prefix="citeflow-code-"), "citeflow_operators.zip")
        with zipfile.ZipFile(where, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(where)
        _SHIPPED.add(sc.applicationId)
    return df.mapInArrow(fn, schema)
