"""Operator 8: removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any document or in the same one.
Such a string begins a suffix, so the work is to sort suffixes and to find neighbours with ``length`` bytes in common.

Which suffixes meet. All suffixes of a corpus cannot be sorted in one place, so they are first dealt by content: each
window of ``length`` bytes has an anchor, the place of its least hash of ``GRAM`` bytes (the leftmost of equals). Equal
windows have equal anchors at equal offsets, so a document is cut into segments (runs of window starts with one anchor),
and only segments whose anchors have equal hashes can share a window.

1. Anchors seen once are dropped (a count by hash, combined before the shuffle).
2. Segments that are equal as a whole (anchor hash and XXH3 of all their bytes, 64 bits each and of different kinds) are repeated in
   full. Only a count is gathered for them, so a passage that a third of all documents share stays cheap.
3. The distinct segments of an anchor are sorted in one bucket: their suffixes, group by group of equal offsets, go
   through a merge sort that compares two suffixes by their longest common extension, found by binary search over prefix
   polynomial hashes (about 8 steps) and one byte comparison. Neighbours with ``length`` common bytes are repeats. Collisions
   are verified: neighbours are compared byte by byte, a comparison whose deciding bytes agree is a collision too, and a
   group with one is decided by its bytes alone.
4. A bucket of more than ``most`` distinct segments is not sorted in one task: its windows are found by a search over narrowing
   ranges of offsets instead, each step a count by Spark of equal contents (128 bits), like step 2.

Nothing is capped or sampled. A document's spans are merged and cut out in one last join with its text.

Cases: a null or empty text, or one shorter than ``length``, has nothing removed; very long texts are cut into chunks
that overlap by ``length - 1`` bytes; repeated rows are copies of each other and lose everything; null ids are kept; an
empty table gives an empty table. All columns are kept; the added ``kept``, ``n_bytes``, ``spans`` must not be among them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from citeflow.llm.common import cut_lineage, map_arrow, slices

GRAM = 40
#: Bytes of texts whose segments are found at once: some fifteen arrays of as many 64-bit numbers are held meanwhile.
STEP = 1 << 19
LONG = 8 << 20
PLACE_BITS = 25
U = np.uint64


class Poly:
    """Prefix polynomial hashes modulo 2^64 with an odd base; ``of`` hashes substrings, places and lengths as arrays."""

    def __init__(self, base: int):
        self.base = base | 1
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)]))
            self.up, self.down = one(self.base), one(self.back)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        return np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * self.up[: len(data)], dtype=U)])

    def of(self, prefix: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (prefix[ends] - prefix[at]) * self.down[at]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


#: Fixed odd base of the prefix hashes.
POLY_A = Poly(0x5851F42D4C957F2D)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours (blockwise prefix and suffix minima)."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.concatenate([x, np.full(blocks * w - len(x), np.iinfo(U).max, U)]).reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie in ``data`` one after another: (text, first start, starts - 1, anchor - first, key, whole).

    ``begins`` has the place of each text and at last the end. Starts are counted in the text. ``whole`` is XXH3 of all bytes of
    the segment's windows and of its shape: no polynomial, so texts that collide in the anchors' hashes do not collide in it too.
    """
    none = tuple(np.empty(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    gram = min(GRAM, length)
    a = POLY_A.prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = mix(POLY_A.of(a, at, at + gram))
    low = U((1 << PLACE_BITS) - 1)
    anchor = (sliding_min((h & ~low) | at.astype(U), length - gram + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(begins, start, "right") - 1
    inside = start + length <= begins[text + 1]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    # a segment ends before the next change of anchor or text, or where windows no longer fit
    change = np.append(np.flatnonzero(new), len(anchor))
    last = np.minimum(change[np.searchsorted(change, first, "right")] - 1, begins[text[first] + 1] - length)
    n, off = last - first, anchor[first] - first
    cuts = map(slice, first.tolist(), (last + length).tolist())
    whole = np.fromiter(map(xxh3_64_intdigest, map(data.tobytes().__getitem__, cuts)), U, len(first))
    whole = mix(whole + mix((n * 4096 + off + length).astype(U)))
    return text[first], first - begins[text[first]], n, off, h[anchor[first]].view(np.int64), whole.view(np.int64)


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Texts gathered to buffers of bounded size: (text number and its offset for each part, data, begins)."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def done():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        return [(i, o) for i, o, _ in parts], data, np.cumsum([0] + [len(p) for _, _, p in parts])

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), LONG):
            part = t[o : o + LONG + length - 1]
            if size and size + len(part) > STEP:
                yield done()
                parts, size = [], 0
            parts.append((i, o, part))
            size += len(part)
    if parts:
        yield done()


def same_group(group: np.ndarray) -> np.ndarray:
    return np.append(group[1:] == group[:-1], False)


class SuffixSorter:
    """Suffixes of one buffer, compared by longest common extensions of at most ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = POLY_A.prefix(data)
        self.collided = np.empty(0, np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at i and j, by binary search over hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), self.length)
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi + 1) // 2
            same = POLY_A.of(self.prefix, i, i + mid) == POLY_A.of(self.prefix, j, j + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix i < suffix j, a hash collided)"""
        n = self.common(i, j)
        cut = n < self.length
        x, y = self.data[i + np.minimum(n, self.length - 1)], self.data[j + np.minimum(n, self.length - 1)]
        return cut & (x < y), cut & (x == y)

    def sort(self, group: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order of suffixes ``at`` inside their groups (``group`` is sorted): merge sort, all groups level by level.

        Two neighbouring runs are merged by ranks: an element's place is its place in its own run plus its rank in the
        other, found by binary search with suffix comparisons (equal suffixes: the left run goes first).
        """
        order = np.arange(len(at))
        begin = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - begin
        place = np.arange(len(at)) - begin
        bad = [np.empty(0, np.int64)]
        run = 1
        while len(size) and run < size.max():
            active = np.flatnonzero(size > run)
            me, p, n, b = at[order[active]], place[active], size[active], begin[active]
            left = (p // run) % 2 == 0
            other = np.where(left, (p // run + 1) * run, (p // run - 1) * run)
            lo, hi = np.minimum(other, n), np.minimum(other + run, n)
            base = lo.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                them = at[order[b[open_] + mid]]
                less, hit1 = self.before(them, me[open_])
                more, hit2 = self.before(me[open_], them)
                bad.append(group[active[open_[hit1 | hit2]]])
                right = np.where(left[open_], less, ~more)  # elements of the other run that go before
                lo[open_] = np.where(right, mid + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], mid)
            target = b + (p // (2 * run)) * 2 * run + p % run + (lo - base)
            moved = order.copy()
            moved[target] = order[active]
            order = moved
            run *= 2
        self.collided = np.unique(np.concatenate(bad))
        return order

    def repeated(self, group: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Flags of suffixes that share ``length`` bytes with another of their group."""
        order = self.sort(group, at)
        near = np.flatnonzero(same_group(group))
        i, j = at[order[near]], at[order[near + 1]]
        equal = self.common(i, j) >= self.length
        near, i, j = near[equal], i[equal], j[equal]
        out = np.zeros(len(at), bool)
        wrong = [self.collided]
        steps = np.arange(self.length)
        for c in range(0, len(near), 1 << 15):  # collision verification, byte by byte
            s = slice(c, c + (1 << 15))
            true = (self.data[i[s][:, None] + steps] == self.data[j[s][:, None] + steps]).all(1)
            out[order[near[s][true]]] = out[order[near[s][true] + 1]] = True
            wrong.append(group[near[s][~true]])
        for g in np.unique(np.concatenate(wrong)):
            lo, hi = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
            seen: dict[bytes, list[int]] = {}
            for x in range(lo, hi):
                seen.setdefault(self.data[at[x] : at[x] + self.length].tobytes(), []).append(x)
            for members in seen.values():
                out[members] = len(members) > 1
        return out


def bucket_repeats(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """Rows (bucket, document, first, starts - 1, anchor - first, bytes) -> (document, first, last start) of repeats."""
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    base = np.cumsum([0] + [len(r[5]) for r in rows])[:-1]
    count = np.array([r[3] + 1 for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    bucket = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
    offset = np.array([r[4] for r in rows], np.int64)[row] - step  # may be negative only for damaged rows
    group = bucket[row] * (2 * length) + offset + length
    order = np.argsort(group, kind="stable")
    group, at = group[order], (base[row] + step)[order]
    both = same_group(group)
    pair = both | np.append(False, both[:-1])
    flags = np.zeros(len(order), bool)
    if pair.any():
        flags[order[pair]] = SuffixSorter(data, length).repeated(group[pair], at[pair])
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    out = []
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        while lo < hi:  # a run of flags may span rows
            r = int(row[lo])
            end = min(hi, int(lo - step[lo] + count[r]))
            out.append((rows[r][1], rows[r][2] + int(step[lo]), rows[r][2] + int(step[lo]) + end - lo - 1))
            lo = end
    return out


def spans_of(n: int, starts: list, length: int) -> np.ndarray:
    """Merged [begin, end) byte spans of runs of repeated starts (first, last)."""
    if not starts:
        return np.empty((0, 2), np.int64)
    runs = np.array(sorted(starts), np.int64).reshape(-1, 2)
    begin, end = runs[:, 0], np.minimum(np.maximum.accumulate(runs[:, 1] + length), n)
    new = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


def _document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
SEGMENT = "doc long, first long, n int, off int, key long, whole long"


def all_segments(docs: DataFrame, length: int) -> DataFrame:
    """Segments of every text of ``docs`` (doc: long, text: string)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                doc = part.column(0).to_numpy()
                texts = [t.encode() for t in part.column(1).to_pylist()]
                for places, data, begins in chunks(texts, length):
                    which, offset = (np.array(x, np.int64) for x in zip(*places))
                    text, first, n, off, key, whole = segments(data, begins, length)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        doc[which[text]], first + offset[text], n.astype(np.int32), off.astype(np.int32), key, whole)],
                        names=["doc", "first", "n", "off", "key", "whole"])

    return map_arrow(docs.select("doc", "text").where(F.octet_length("text") >= length), run, SEGMENT)


def _with_bytes(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``wanted`` segments (key, doc, first, n, off) with their bytes, one fetch a document."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "n", "off")).alias("want"))
    joined = docs.join(lists, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "first", "n", "off", "bytes"]
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, text, want in zip(*(part.column(i).to_pylist() for i in range(3))):
                    data = text.encode()
                    rows += [(w["key"], doc, w["first"], w["n"], w["off"], data[w["first"] : w["first"] + w["n"] + length]) for w in want]
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    out = map_arrow(joined.select("doc", "text", "want"), run, "key long, doc long, first long, n int, off int, bytes binary")
    return out


def _sorted_buckets(rows: DataFrame, length: int, most_windows: int = 1 << 18) -> DataFrame:
    """Suffix sort of whole buckets: repeated starts as (doc, first, last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done():
            found = bucket_repeats(held, length)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size > most_windows and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += row[3] + 1
        if held:
            yield done()

    dealt = rows.repartition("key").sortWithinPartitions("key").select("key", "doc", "first", "n", "off", "bytes")
    return map_arrow(dealt, run, "doc long, first long, last long")


def range_hashes(data: bytes, off: int, n: int, a: int, b: int, length: int) -> tuple[int, ...]:
    """For a segment's windows whose anchor offset is in [a, b]: the least and the greatest such offset, the two halves of
    a 128-bit hash of the bytes that all windows of the range have in common, and those of all bytes of the segment's own windows in it."""
    low, high = max(a, off - n), min(b, off)
    core = (off - a, max(off - a, off - b + length))
    whole = (off - high, off - low + length)
    out = [low, high]
    for x, y in (core, whole):
        out += struct.unpack("<qq", xxh3_128_digest(data[x:y], seed=y - x))
    return tuple(out)


def _narrowed_ranges(rows: DataFrame, length: int, width: int = 64) -> DataFrame:
    """Large buckets by a search over ranges of anchor offsets, every step a count by Spark.

    Segments that agree in all bytes of their windows in a range are repeated there as a whole; segments whose common
    bytes of the range are unique have no repeat in it; the others go on, one for each distinct content, with the range
    cut in four, down to single windows. So a segment that differs from a thousand others beyond some byte gives a row a step,
    not a row a window.
    """
    spark = rows.sparkSession
    tops = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(a + width - 1).alias("b")) for a in range(0, length, width)])
    now = rows.select("key", "doc", "first", "n", "off", "bytes", F.explode(tops).alias("r")).select(
        "key", "doc", "first", "n", "off", "bytes", "r.a", "r.b")
    inside = "a <= off and b >= off - n"
    found = spark.createDataFrame([], "doc long, first long, last long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            made = [range_hashes(d, o, n, x, y, length)
                    for d, o, n, x, y in zip(cols["bytes"], cols["off"], cols["n"], cols["a"], cols["b"])]
            new = list(zip(*made)) if made else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int32()) for c in new[:2]), *(pa.array(c, pa.int64()) for c in new[2:])],
                names=[*batch.schema.names, "low", "high", "core", "core2", "whole", "whole2"])

    schema = "key long, doc long, first long, n int, off int, bytes binary, a int, b int, low int, high int, core long, core2 long, whole long, whole2 long"
    core, whole = ["key", "a", "core", "core2"], ["whole", "whole2", "low", "high"]
    while width:
        hashed = cut_lineage(map_arrow(now.where(inside), run, schema), "ranges")
        if hashed.isEmpty():
            break
        wholes = cut_lineage(hashed.groupBy(*core, *whole).agg(
            F.count("*").alias("copies"), F.min(F.struct("doc", "first", "n", "off", "bytes")).alias("one")), "range-wholes")
        same = hashed.join(wholes.where("copies > 1").select(*core, *whole), [*core, *whole], "left_semi")
        found = found.unionByName(same.select("doc", (F.col("first") + F.col("off") - F.col("high")).alias("first"),
                                              (F.col("first") + F.col("off") - F.col("low")).alias("last")))
        open_ = wholes.groupBy(*core).agg(F.count("*").alias("distinct")).where("distinct > 1").select(*core)
        width //= 4
        parts = F.array(*[F.struct((F.col("a") + i * width).alias("a"), (F.col("a") + (i + 1) * width - 1).alias("b")) for i in range(4)])
        now = wholes.join(open_, core, "left_semi").select("key", "one.*", "a").withColumn("r", F.explode(parts)).select(
            "key", "doc", "first", "n", "off", "bytes", "r.a", "r.b")
    return found


def repeated_starts(docs: DataFrame, length: int = 200, most: int = 1024) -> DataFrame:
    """``docs`` (doc, text) -> runs of repeated window starts: doc, first, last (runs may overlap)."""
    found = all_segments(docs, length)
    keys = cut_lineage(found.groupBy("key").count().where("count > 1").select("key"), "anchors")
    shared = cut_lineage(found.join(keys.hint("shuffle_hash"), "key", "left_semi"), "segments")
    wholes = cut_lineage(shared.groupBy("key", "whole").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "first", "n", "off")).alias("one")), "wholes")
    in_full = shared.join(wholes.where("copies > 1").select("key", "whole"), ["key", "whole"], "left_semi").select(
        "doc", "first", (F.col("first") + F.col("n")).alias("last"))
    per_key = wholes.groupBy("key").agg(F.count("*").alias("distinct")).where("distinct > 1")
    bucketed = wholes.join(per_key, "key").select("key", "distinct", "one.*")
    fetched = cut_lineage(_with_bytes(bucketed, docs, length), "buckets")
    large = per_key.where(F.col("distinct") > most).select("key")
    small = _sorted_buckets(fetched.join(large, "key", "left_anti"), length)
    counted = _narrowed_ranges(fetched.join(large, "key", "left_semi"), length)
    return in_full.unionByName(small).unionByName(counted)


def remove_repeats(docs: DataFrame, length: int = 200, most: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                   as_text: bool = False) -> DataFrame:
    """``docs`` without ``text_col``, with n_bytes, spans (removed byte spans [begin, end)) and kept (the other bytes).

    ``as_text`` gives ``kept`` as a string: a character of which a span took some bytes goes as a whole.
    """
    df = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("__doc", _document_key(id_col, text_col))
    starts = repeated_starts(df.select(F.col("__doc").alias("doc"), F.col(text_col).alias("text")), length, most)
    lists = starts.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("first", "last")).alias("__starts"))
    joined = df.join(lists, "__doc", "left").drop("__doc")
    packed = joined.withColumn("__pair", F.struct(F.col(text_col), F.col("__starts"))).drop(text_col, "__starts")
    at = packed.columns.index("__pair")
    keep = [c for c in packed.columns if c != "__pair"]
    schema = packed.drop("__pair").schema.add("n_bytes", "long").add("spans", SPANS).add("kept", "string" if as_text else "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, spans, kept = [], [], []
                for row in part.column(at).to_pylist():
                    data = row[text_col].encode()
                    cut = spans_of(len(data), [(s["first"], s["last"]) for s in row["__starts"] or ()], length).tolist()
                    sizes.append(len(data))
                    spans.append([{"begin": a, "end": b} for a, b in cut])
                    edges = [0, *(x for c in cut for x in c), len(data)]
                    rest = [data[a:b] for a, b in zip(edges[::2], edges[1::2])]
                    kept.append("".join(x.decode("utf-8", "ignore") for x in rest) if as_text else b"".join(rest))
                cols = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())],
                                                 names=[*keep, "n_bytes", "spans", "kept"])

    return map_arrow(packed, run, schema)
