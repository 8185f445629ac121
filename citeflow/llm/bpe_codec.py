"""Operator 1: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token costs one hash and one
comparison. Tier two, for all other pre-tokens, merges linked bytes with a heap of candidate pairs, lowest rank first,
leftmost first among equals.

Cases: a null or empty text has no ids and decodes to no bytes; very long texts are worked on in segments; repeated rows
are encoded alike; an empty table gives an empty table; other columns of the input are kept as they are. The operator's
own columns (``ids``, ``decoded``) may not be present in the input: name others with ``ids_col``/``decoded_col``.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from citeflow.llm.common import map_texts, text_or_empty
from citeflow.llm.pretokens import PieceEncoder, shared_encoder

MASK = (1 << 64) - 1


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line.strip())}


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: hash, then displace (one displacement a bucket).

    ``slot(key)`` is in ``range(n)``, distinct for distinct members; any other key also gets a slot, so ``get`` compares
    the key stored there.
    """

    def __init__(self, items: dict[bytes, int], per_bucket: int = 3):
        self.n = max(1, len(items))
        self.buckets = max(1, self.n // per_bucket)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [-1] * self.n
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for key in items:
            h = xxh64_intdigest(key)
            by_bucket.setdefault(h % self.buckets, []).append((h, key))
        for bucket, members in sorted(by_bucket.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            d = 0
            while True:
                at = [self._place(h, d) for h, _ in members]
                if len(set(at)) == len(at) and all(self.keys[i] is None for i in at):
                    break
                d += 1
            self.shift[bucket] = d
            for i, (_, key) in zip(at, members):
                self.keys[i], self.values[i] = key, items[key]
        free = (i for i in range(self.n) if self.keys[i] is None)
        for bucket, members in by_bucket.items():
            if len(members) == 1:  # a bucket of one names its slot directly
                i, key = next(free), members[0][1]
                self.shift[bucket] = -1 - i
                self.keys[i], self.values[i] = key, items[key]

    def _place(self, h: int, d: int) -> int:
        x = ((h >> 17) ^ (d * 0x9E3779B97F4A7C15)) & MASK
        x = (x * 0xD6E8FEB86659FD93) & MASK
        return (x >> 20) % self.n

    def slot(self, key: bytes) -> int:
        h = xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self._place(h, d) if d >= 0 else -1 - d

    def get(self, key: bytes) -> int:
        i = self.slot(key)
        return self.values[i] if self.keys[i] == key else -1


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 20 | right id) -> id of the joined token, for every split of every token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a << 20 | b] = rank
    return out


def merge_bytes(word: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token: a heap of (rank, place) over a doubly linked list of parts; stale entries are skipped."""
    ids = [byte_ids[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = pairs.get(ids[i] << 20 | ids[i + 1])
        if r is not None:
            heap.append(r << 40 | i)
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, r = top & 0xFFFFFFFFFF, top >> 40
        j = after[i]
        if ids[i] < 0 or j >= n or pairs.get(ids[i] << 20 | ids[j]) != r:
            continue
        ids[i], ids[j] = r, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            x = pairs.get(r << 20 | ids[k])
            if x is not None:
                heappush(heap, x << 40 | i)
        p = before[i]
        if p >= 0:
            x = pairs.get(ids[p] << 20 | r)
            if x is not None:
                heappush(heap, x << 40 | p)
    return [x for x in ids if x >= 0]


class ByteBPE:
    """Encoder of one rank file."""

    def __init__(self, blob: bytes, pattern: str):
        ranks = read_ranks(blob)
        self.whole = PerfectHash(ranks)
        self.pairs = pair_table(ranks)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.pieces = PieceEncoder(self.encode_piece)

    def encode_piece(self, piece: str) -> list[int]:
        out: list[int] = []
        for pre in self.find(piece):
            word = pre.encode()
            one = self.whole.get(word)
            if one >= 0:
                out.append(one)
            else:
                out.extend(merge_bytes(word, self.byte_ids, self.pairs))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.pieces.encode(text)


class Decoder:
    """Bytes of ids: one table of tokens."""

    def __init__(self, blob: bytes):
        ranks = read_ranks(blob)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(blob, pattern: str) -> ByteBPE:
    return shared_encoder("bpe" + pattern, blob.value, lambda: ByteBPE(blob.value, pattern))


def vocabulary(spark, path: str):
    """The vocabulary file, read once on the driver and sent to the executors (its size does not follow the data)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace ``text_col`` by ``ids_col``: the ids as little-endian unsigned 32-bit integers (binary)."""
    blob = vocabulary(docs.sparkSession, path)
    df = docs.withColumn(text_col, text_or_empty(text_col))

    def make():
        codec = _codec(blob, pattern)
        return lambda texts: [pa.array([codec.encode(t).astype("<u4").tobytes() for t in texts], pa.binary())]

    return map_texts(df, text_col, f"{ids_col} binary", make, keeps_table=True)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add ``decoded_col``: the bytes that the ids in ``ids_col`` (as ``encode`` writes them; null: none) stand for."""
    blob = vocabulary(docs.sparkSession, path)
    df = docs.withColumn("__ids", F.col(ids_col))

    def make():
        codec = shared_encoder("tokens", blob.value, lambda: Decoder(blob.value))
        return lambda rows: [pa.array([codec.decode(np.frombuffer(r or b"", "<u4").tolist()) for r in rows], pa.binary())]

    return map_texts(df, "__ids", f"{decoded_col} binary", make, keeps_table=True)
