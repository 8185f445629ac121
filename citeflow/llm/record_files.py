"""Operator 5: token ids in length-delimited binary record files, with a separate offset index.

One shard is two files in a shared folder, written through Arrow's file systems (``file:``, ``hdfs:``, ``s3:`` ...):

* ``*.rec``: records one after another. A record is the payload's length (unsigned 64-bit), the masked checksum of these
  8 bytes, the payload, and the masked checksum of the payload. A checksum is CRC-32, rotated right by 15 bits plus a
  constant (so that a checksum of data that holds checksums stays sound). The payload is the ids, 16 or 32 bits each.
* ``*.idx``: a header (magic, id width, records) and for each record its document id, byte offset, ids before it in the
  shard and number of ids: a reader can fetch any record by itself, in any order.

Everything is little-endian. The manifest (a Parquet table beside the shards, written by Spark) names the files of the
task attempts that succeeded, so files that a lost executor left behind are never read.

Cases: a null or empty text is the end id alone; a null id sorts first and stays null; equal ids are ordered by a hash of
the text, equal rows follow one another; an empty table gives no shards; other columns are not looked at. The id column
must hold integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from citeflow.llm.bpe_codec import vocabulary
from citeflow.llm.common import map_arrow, slices
from citeflow.llm.pretokens import library_encoder, shared_encoder

MAGIC = b"CFREC01\n"
HEADER = "<8sIQ"
ENTRY = np.dtype([("id", "<i8"), ("has_id", "u1"), ("at", "<u8"), ("first", "<u8"), ("n", "<u8")])
MASK_DELTA = 0xA282EAD8
READ_BYTES = 4 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at byte ``at`` and the byte after the record; a damaged record raises."""
    head = bytes(data[at : at + 8])
    n, crc = struct.unpack("<Q", head)[0], struct.unpack("<I", data[at + 8 : at + 12])[0]
    if masked_crc(head) != crc:
        raise ValueError(f"record at {at}: its length is damaged")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or masked_crc(payload) != struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0]:
        raise ValueError(f"record at {at}: its payload is damaged")
    return payload, at + 16 + n


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def write_records(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id",
                  text_col: str = "text") -> None:
    """Encode, append ``end_id``, and write shards to ``folder`` in ascending id order. One shuffle, by ranges of ids."""
    blob = vocabulary(docs.sparkSession, path)
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    df = df.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")

    width = 2 if encoder_size(blob.value) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder("bytes" + pattern, blob.value, lambda: library_encoder(blob.value, pattern, False))
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store = where = out = None
        entries, at, first = [], 0, 0
        for batch in batches:
            for part in slices(batch, 1):
                if out is None:
                    store, where = open_folder(folder)
                    store.create_dir(f"{where}/shards", recursive=True)
                    out = store.open_output_stream(f"{where}/shards/{name}.rec")
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text), np.int32(end_id))
                    record = frame(ids.astype(f"<u{width}").tobytes())
                    out.write(record)
                    entries.append((key or 0, key is not None, at, first, len(ids)))
                    at += len(record)
                    first += len(ids)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{where}/shards/{name}.idx") as f:
            f.write(struct.pack(HEADER, MAGIC, width, len(entries)))
            f.write(np.array(entries, ENTRY).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [name], "records": [len(entries)], "ids": [first], "bytes": [at]})

    (map_arrow(df, run, "shard long, file string, records long, ids long, bytes long", keeps_table=True)
       .write.mode("errorifexists").parquet(f"{folder}/manifest"))


def encoder_size(tokenizer_json: bytes) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json.decode()).get_vocab_size()


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records: id, start (ids of all earlier records), n, ids (little-endian unsigned 32-bit).

    Shards are read in parallel; the running sum is over one manifest row a shard. Checksums are verified.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before).select("file", "before")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_shard(folder, row["file"], row["before"])

    return map_arrow(shards.repartition(n, "file"), run, "id long, start long, n long, ids binary")


def read_shard(folder: str, name: str, before: int) -> Iterator[pa.RecordBatch]:
    store, where = open_folder(folder)
    with store.open_input_file(f"{where}/shards/{name}.idx") as f:
        magic, width, n = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError(f"{name}.idx: not an index of record files")
        index = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
    with store.open_input_file(f"{where}/shards/{name}.rec") as f:
        size, begin = f.size(), 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(index["at"], index["at"][begin] + READ_BYTES)))
            lo, hi = int(index["at"][begin]), int(index["at"][end]) if end < n else size
            data = memoryview(f.read_at(hi - lo, lo))
            rows = index[begin:end]
            payloads = [unframe(data, int(a) - lo)[0] for a in rows["at"]]
            ids = [np.frombuffer(p, f"<u{width}").astype("<u4").tobytes() for p in payloads]
            yield pa.RecordBatch.from_arrays([
                pa.array(rows["id"], pa.int64(), mask=rows["has_id"] == 0), pa.array(rows["first"].astype(np.int64) + before),
                pa.array(rows["n"].astype(np.int64)), pa.array(ids, pa.binary())], names=["id", "start", "n", "ids"])
            begin = end
