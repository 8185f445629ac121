"""Operator 6: approximate nearest neighbours by a hash-prefix forest.

A tree turns a vector into a string of digits: the vector is rotated at random and its coordinates are listed by falling
absolute value, each with its sign. Near vectors share long prefixes. A tree is the sorted array of the strings of its
rows; the rows that share a prefix with a query are a run of it, found by binary search. A query descends in all trees to
its longest matches, then ascends in all of them at once, a digit a time, until the runs together hold ``candidates`` rows
(or all rows). Candidates are ranked by the inner product in double precision, ties by the smaller id.

Scale: rows are dealt by a hash of the id into shards of about ``shard_rows``; every shard holds a forest over its rows, all
of them, and the queries (a stated set) go to every shard in blocks. A task holds one shard and one block of queries. Rows
with equal vectors are one entry of a forest, so a vector that many rows share costs no more than any other and its ties are
exact. Each shard returns ``k`` rows a query; a window keeps the best ``k`` of them.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids; vectors of
different lengths are never candidates of one another; repeated rows (equal id) count once, with their first vector in
ascending order; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeflow.llm.common import map_arrow

#: Digits of a string (vectors of fewer dimensions have one a dimension).
DIGITS = 16
QUERY_BLOCK = 1024


def rotations(dim: int, trees: int, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng([seed, dim])
    return np.stack([np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(trees)]).astype(np.float32)


def strings(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The digits of each row as a string of bytes: one a digit, or two (big-endian) from 127 dimensions on."""
    y = x @ rotation
    n = min(DIGITS, y.shape[1])
    size = np.abs(y)
    out = np.zeros((len(x), n), np.uint8 if 2 * y.shape[1] < 255 else ">u2")
    row = np.arange(len(x))
    for i in range(n):
        at = size.argmax(1)
        out[:, i] = 2 * at + (y[row, at] > 0) + 1
        size[row, at] = -1
    return as_strings(out)


def as_strings(digits: np.ndarray) -> np.ndarray:
    """Rows of digits as byte strings of one length, which numpy compares from their first byte on."""
    return np.ascontiguousarray(digits).view(f"S{digits.shape[1] * digits.itemsize}").ravel()


class Tree:
    """The sorted strings of the rows of a shard, and which row each belongs to."""

    def __init__(self, string: np.ndarray, depth: int):
        self.rows = np.argsort(string, kind="stable")
        self.strings, self.depth = string[self.rows], depth
        self.kind = np.dtype(np.uint8 if string.itemsize == depth else ">u2")

    def digits(self, string: np.ndarray) -> np.ndarray:
        return string.view(self.kind).reshape(-1, self.depth)

    def descend(self, own: np.ndarray) -> np.ndarray:
        """Length of the longest prefix that each query's string shares with a row's: one of its neighbours has it."""
        at, mine = np.searchsorted(self.strings, own), self.digits(own)
        longest = np.zeros(len(own), np.int64)
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.strings) - 1)):
            same = self.digits(self.strings[near]) == mine
            longest = np.maximum(longest, np.logical_and.accumulate(same, axis=1).sum(1))
        return longest

    def run(self, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the rows that share the first ``length`` digits with each query."""
        low, high = self.digits(own).copy(), self.digits(own).copy()
        low[:, length:], high[:, length:] = 0, np.iinfo(self.kind).max
        return np.searchsorted(self.strings, as_strings(low)), np.searchsorted(self.strings, as_strings(high), "right")


class Forest:
    """All trees over the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, candidates: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, at = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(at, kind="stable")  # members of a vector stay in ascending id
        self.members, self.member_begin = ids[by], np.searchsorted(at[by], np.arange(len(first) + 1))
        self.exact = x[first].astype(np.float64)
        self.near = x[first].astype(np.float32)
        self.dim, self.candidates = x.shape[1], candidates
        self.depth = min(DIGITS, self.dim)
        self.largest = float(np.sqrt((self.exact**2).sum(1).max()))
        self.rotations = rotations(self.dim, trees)
        self.trees = [Tree(strings(self.near, r), self.depth) for r in self.rotations]

    def matches(self, q32: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin and end of each query's run in each tree, depth of each query): the depth at which its runs hold enough rows.

        A query descends in every tree to its own longest match; the ascent is synchronous: a tree whose match is shorter joins
        in when the others have come up to it. At depth 0, the root, all rows are one run, given for the first tree.
        """
        own = [strings(q32, r) for r in self.rotations]
        deep = np.stack([tree.descend(o) for tree, o in zip(self.trees, own)])
        lo, hi = np.zeros(deep.shape, np.int64), np.zeros(deep.shape, np.int64)
        level, open_ = np.zeros(len(q32), np.int64), np.arange(len(q32))
        for up in range(int(deep.max(initial=0)), 0, -1):
            for t, tree in enumerate(self.trees):
                here = open_[deep[t, open_] >= up]
                if len(here):
                    lo[t, here], hi[t, here] = tree.run(own[t][here], up)
            enough = (hi - lo)[:, open_].sum(0) >= self.candidates
            level[open_[enough]] = up
            open_ = open_[~enough]
            if not len(open_):
                break
        lo[:, open_] = hi[:, open_] = 0
        hi[0, open_] = len(self.exact)
        return lo, hi, level

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the best ``k`` candidates of each query in this shard."""
        q32, q64 = q.astype(np.float32), q.astype(np.float64)
        n = len(self.exact)
        lo, hi, _ = self.matches(q32)
        slack = 1e-4 * self.largest * np.sqrt((q64**2).sum(1).max())
        pairs = []
        for t, tree in enumerate(self.trees):
            a, b = lo[t], hi[t]
            picked = np.flatnonzero(b > a)
            picked = picked[np.lexsort((b[picked], a[picked]))]
            cuts = np.flatnonzero(np.diff(a[picked]) | np.diff(b[picked])) + 1
            for same in np.split(picked, cuts) if len(picked) else ():
                run = tree.rows[a[same[0]] : b[same[0]]]
                score = q32[same] @ self.near[run].T
                least = np.partition(score, -k - 1, axis=1)[:, -k - 1] - slack if score.shape[1] > k + 1 else np.full(len(same), -np.inf)
                i, j = np.nonzero(score >= least[:, None])
                pairs.append(same[i] * n + run[j])
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        pairs = np.unique(np.concatenate(pairs))
        i, j = pairs // n, pairs % n
        score = np.concatenate([(self.exact[j[c : c + 65536]] * q64[i[c : c + 65536]]).sum(1) for c in range(0, len(i), 65536)])
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(i, np.arange(len(q)))
        at_k = np.minimum(begin[i] + k, np.append(begin[1:], len(i))[i] - 1)
        keep = score >= score[at_k]  # k + 1 vectors and all ties: one of them may be the query itself
        i, j, score = i[keep], j[keep], score[keep]
        n_of = np.minimum(self.member_begin[j + 1] - self.member_begin[j], k + 1)  # ties go to small ids
        at = np.repeat(self.member_begin[j] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
        i, score, found = np.repeat(i, n_of), np.repeat(score, n_of), self.members[at]
        other = found != query_ids[i]
        i, score, found = i[other], score[other], found[other]
        order = np.lexsort((found, -score, i))
        i, score, found = i[order], score[order], found[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        return query_ids[i[top]], found[top], score[top]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           trees: int = 48, candidates: int = 2048, shard_rows: int = 16384) -> DataFrame:
    """Rows of ``rows`` for which ``is_query`` holds are searched among all rows: query_id, rank (from 1), id, score."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(F.col("id").isNotNull() & usable(F.col("v")))
    base = base.groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.v", "r.q")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    own = base.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v")
    asks = base.where("q").select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    dealt = own.unionByName(asks).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, forest = None, [], [], None

        def answer(query_ids, q):
            for at in range(0, len(q), QUERY_BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest.search(query_ids[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK], k)],
                                                 names=["query_id", "id", "score"])

        for batch in batches:
            dim, shard, kind, key = (batch.column(i).to_numpy() for i in range(4))
            vector = batch.column(4)
            cuts = np.flatnonzero(np.diff(dim) | np.diff(shard) | np.diff(kind)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if hi == lo:
                    continue
                x = vector.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dim[lo])
                if now != (dim[lo], shard[lo]):
                    now, ids, vectors, forest = (dim[lo], shard[lo]), [], [], None
                if not kind[lo]:
                    ids.append(key[lo:hi])
                    vectors.append(x)
                elif ids:
                    if forest is None:
                        forest = Forest(np.concatenate(ids), np.concatenate(vectors), trees, candidates)
                    yield from answer(key[lo:hi], x)

    found = map_arrow(dealt, run, "query_id long, id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
