"""Operator 4: SimHash near-duplicates by tiled exact comparison.

Fingerprints: XXH64 of every word shingle; a bit of the fingerprint is 1 if more than half of the shingles have it.

Links: all distinct fingerprints are compared, tile against tile, with numpy's exclusive-or and bit counts. A fingerprint's
cell is the population counts of its four 16-bit quarters. Two fingerprints within ``radius`` bits have cells within
``radius`` in the sum of absolute differences, so tiles (runs of neighbouring cells) whose counts differ beyond the radius
are never paired, and inside a pair of tiles a cell meets only the cells within the radius. This skips about 95 % of the
comparisons and loses no link.

Scale: equal fingerprints are one row before any comparison, so a group of copies costs nothing, however large. The plan of
tiles is made from the histogram of cells, which has 17^4 rows at most. A tile holds ``tile`` fingerprints (a cell larger
than that is split by a hash), a task two tiles. A pair of tiles reports a spanning forest of its links, which has the same
components, so a large group of near copies does not give all its pairs.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; documents shorter than a shingle
are one shingle; repeated rows get equal results; an empty table gives an empty table. All columns of the input are kept;
it may not have columns named like the results (``fingerprint``, ``component_id``, ``component``), others are free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from citeflow.llm.common import cut_lineage, map_arrow, map_texts
from citeflow.llm.components import connected_components

#: Shingles hashed at a time.
RUN = 1 << 16
QUARTERS = 4


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text (unsigned)."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z only, white space 0x20 and 0x09-0x0D only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    k = min(words, len(parts))
    begins, ends = begins[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), RUN):
        b, e = begins[at : at + RUN], ends[at : at + RUN]
        h = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(b, e)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begins), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, words: int = 4, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``out_col`` (the 64 bits as a signed long)."""
    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], "<u8").view("<i8"))]

    return map_texts(docs, text_col, f"{out_col} long", make)


def cells_of(fps: np.ndarray) -> np.ndarray:
    """Population counts of the quarters, as rows of small integers."""
    return np.bitwise_count(np.ascontiguousarray(fps).view("<u2").reshape(-1, QUARTERS)).astype(np.int16)


def plan_tiles(cells: list[tuple[int, int, int, int, int]], tile: int, radius: int) -> tuple[list[tuple], list[tuple]]:
    """Tiles from the histogram of cells ``(c0, c1, c2, c3, count)``.

    Returns ``(c0, c1, c2, c3, first tile, tiles)`` for each cell and ``(pair, tile, side)`` for each pair of tiles whose
    bounding boxes are within the radius; a pair of a tile with itself has side 2.
    """
    placed, boxes, room = [], [], 0
    for *cell, n in sorted(cells):
        if n > tile:
            parts = math.ceil(n / tile)
            placed.append((*cell, len(boxes), parts))
            boxes += [(np.array(cell), np.array(cell))] * parts
            room = 0
            continue
        if n > room:
            boxes.append((np.array(cell), np.array(cell)))
            room = tile
        lo, hi = boxes[-1]
        boxes[-1] = (np.minimum(lo, cell), np.maximum(hi, cell))
        placed.append((*cell, len(boxes) - 1, 1))
        room -= n
    lo, hi = (np.array([b[i] for b in boxes]).reshape(-1, QUARTERS) for i in (0, 1))
    pairs = []
    for t in range(len(boxes)):
        apart = np.maximum(0, np.maximum(lo[t:] - hi[t], lo[t] - hi[t:])).sum(1)
        for u in (np.flatnonzero(apart <= radius) + t).tolist():
            p = len(pairs)
            pairs.append((p, t, 2 if u == t else 0, u))
    rows = [(p, t, side) for p, t, side, _ in pairs] + [(p, u, 1) for p, t, side, u in pairs if side != 2]
    return placed, rows


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int, most: int = 1 << 21) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``a`` (if ``b`` is None) or between ``a`` and ``b``: pairs of fingerprints."""
    alone = b is None
    fps = a if alone else np.concatenate([a, b])
    group = lambda x: np.unique(cells_of(x), axis=0, return_inverse=True)

    def runs(x):
        cells, at = group(x)
        order = np.argsort(at, kind="stable")
        return cells, order, np.searchsorted(at[order], np.arange(len(cells) + 1))

    cells_a, order_a, begin_a = runs(a)
    cells_b, order_b, begin_b = (cells_a, order_a, begin_a) if alone else runs(b)
    shift = 0 if alone else len(a)
    root = np.arange(len(fps))
    forest = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for c in range(len(cells_a)):
        near = np.flatnonzero(np.abs(cells_b - cells_a[c]).sum(1) <= radius)
        if alone:
            near = near[near >= c]
        if not len(near):
            continue
        left_all = order_a[begin_a[c] : begin_a[c + 1]]
        right = np.concatenate([order_b[begin_b[i] : begin_b[i + 1]] for i in near])
        step = max(1, most // len(right))
        for at in range(0, len(left_all), step):
            left = left_all[at : at + step]
            hits = np.bitwise_count(fps[left][:, None] ^ fps[right + shift][None, :]) <= radius
            x, y = np.nonzero(hits)
            x, y = left[x], right[y] + shift
            open_ = root[x] != root[y]
            for i, j in zip(x[open_].tolist(), y[open_].tolist()):
                p, q = top(i), top(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    forest.append((i, j))
            if open_.any():
                while not np.array_equal(flat := root[root], root):
                    root[:] = flat
    return [(int(fps[i].astype("<i8")), int(fps[j].astype("<i8"))) for i, j in forest]


def link_fingerprints(fps: DataFrame, radius: int = 4, tile: int = 32768, most_tiles: int = 1024) -> DataFrame:
    """Distinct fingerprints (``fp``: long) -> links (u, v: long) with the components of all pairs within ``radius``.

    ``tile`` grows with the number of fingerprints where that would give more than ``most_tiles`` tiles, so that the plan
    of tiles stays small on the driver.
    """
    spark = fps.sparkSession
    quarter = [F.expr(f"cast(bit_count(shiftrightunsigned(fp, {16 * i}) & 65535) as int)").alias(f"c{i}") for i in range(QUARTERS)]
    celled = fps.select("fp", *quarter)
    names = [f"c{i}" for i in range(QUARTERS)]
    counts = [(*r[:QUARTERS], r[QUARTERS]) for r in celled.groupBy(*names).count().collect()]  # 17^4 rows at most
    tile = max(tile, math.ceil(sum(r[-1] for r in counts) / most_tiles))
    placed, pairs = plan_tiles(counts, tile, radius)
    place = spark.createDataFrame(placed, ", ".join(f"{n} int" for n in names) + ", first int, parts int")
    route = spark.createDataFrame(pairs, "pair long, tile int, side int")
    tiled = celled.join(F.broadcast(place), names).select(  # as many rows as there are cells
        "fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).alias("tile"))
    blocks = tiled.groupBy("tile").agg(F.collect_list("fp").alias("fps"))  # a row is a tile: its size is bounded
    to = F.broadcast(route.groupBy("tile").agg(F.collect_list(F.struct("pair", "side")).alias("to")))
    rows = blocks.join(to, "tile").select(F.explode("to").alias("to"), "fps").select("to.pair", "to.side", "fps")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(len(pairs), max(4 * parts, len(pairs) // 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            pair, side = (batch.column(i).to_pylist() for i in range(2))
            for i, (p, s) in enumerate(zip(pair, side)):
                fps = batch.column(2).slice(i, 1).flatten().to_numpy().view("<u8")
                if s == 2:
                    found = link_tiles(fps, None, radius)
                elif held is not None and held[0] == p:
                    found = link_tiles(held[1], fps, radius)
                    held = None
                else:  # the first tile of a pair waits for the second, its neighbour in the order
                    held = (p, fps.copy())
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], names=["u", "v"])

    grouped = rows.repartition(tasks, "pair").sortWithinPartitions("pair", "side")
    return map_arrow(grouped, run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    tile: int = 32768) -> DataFrame:
    """``docs`` without ``text_col``, with ``fingerprint`` (signed long), ``component_id`` (smallest id reachable) and
    ``component`` (the component's least fingerprint, which names it also where ids are null).

    Rows with a null id take part; a component of null ids only has a null component_id.
    """
    base = cut_lineage(add_fingerprints(docs, words, text_col), "fingerprints")
    classes = cut_lineage(base.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.col(id_col)).alias("least")), "classes")
    roots = connected_components(link_fingerprints(classes.select("fp"), radius, tile))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("fp").alias("__fp"), "component_id", F.col("root").alias("component"))
    return base.join(of, F.col("fingerprint") == F.col("__fp")).drop("__fp")


def keep_one(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near duplicates (the smallest id, then the smallest hash of the text), all columns.

    Rows equal in id and text are one row.
    """
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h")]
    found = near_duplicates(docs.select(*key, F.col(text_col).alias("__text")), radius, words, "__id", "__text")
    stays = found.groupBy("component").agg(F.min(F.struct("__id", "__h")).alias("one")).select("one.*")
    rows = docs.withColumn("__h1", F.xxhash64(text_col)).join(
        stays, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__h")), "left_semi")
    return rows.dropDuplicates([id_col, "__h1"]).drop("__h1")
