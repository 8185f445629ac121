"""Operator 12: ranked lexical search by the Best Position Algorithm over impact lists.

A term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, its impact in a document ``(10^9 * tf) div (1000 * tf
+ 12 * m)`` with ``m = 100 - 25 + ((25 * n * N) div L)``; a document's score for an item is the sum of weight times impact
over the item's terms, repeats included (N documents with terms, L terms in all, n of the document).

Plan. Items come in blocks of at most about ``most_terms`` distinct (item, term) pairs, dealt by item, so the queries that
are broadcast are bounded (by the terms of one item if that has more).

1. One pass cuts texts into words and keeps, for each group of documents, the counts of the block's terms. It is written
   once, as packed arrays. N, L and the df of each term are sums over it (at most one row a term to the driver).
2. A task gathers groups to shards of bounded size and sorts the shard's impact lists. For an item, all its lists are read
   in steps from their best positions (the end of the contiguous run of seen positions). A document met for the first time
   is accessed directly: its own postings give its score and its position in every other list of the item, which are then
   seen too and may advance the best positions there. Reading stops when the sum of weighted impacts at the best positions is
   *strictly* below the k-th score (so that ties are complete), or zero. The k-th score is that of all shards of the task
   so far, so later shards stop earlier.
3. A task gives at most k rows an item; they are merged in two steps (salted, then by item), so no task gets the rows of all
   others.

Nothing is sampled: every document with a term of an item is read or shown to be below the k-th.

Cases: a null or empty text has no terms and is not counted; an item without terms, or whose terms are in no document, has
no rows; repeated documents are ranked each, equal scores by ascending document id (null ids last); repeated items are
ranked each; very long texts are ordinary documents; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeflow.llm.common import cut_lineage, map_arrow, slices
from citeflow.llm.words import texts_of, word_ids, words_of

#: Postings of a shard (a larger group of documents is a shard of its own).
SHARD_POSTINGS = 2 << 20
#: Positions that a list is read at first; every round reads twice as many.
FIRST_STEP = 16
SALTS = 64
GROUP = "docs long, terms long, df array<struct<term:int,n:long>>, ids binary, no_id binary, n binary, size binary, term binary, tf binary"


def terms_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key of the item's row, its id, term, times) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                for key, item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2))):
                    counts = Counter(words_of(text))
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([item] * n, part.schema.field(1).type),
                                                      pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                                                     names=["key", "item", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"key long, item {items.schema[id_col].dataType.simpleString()}, term string, times long")


def postings(docs: DataFrame, id_col: str, text_col: str, known: dict[str, int]) -> DataFrame:
    """Groups of documents with the counts of ``known`` terms, as packed arrays, and the group's sums."""
    block = docs.sparkSession.sparkContext.broadcast({t.encode(): i + 1 for t, i in known.items()})
    most = len(known) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, n = word_ids(texts_of(part.column(1)), block.value)
                doc = np.repeat(np.arange(len(n)), n)[ids > 0]
                pair, tf = np.unique(doc * most + ids[ids > 0], return_counts=True)
                doc, term = pair // most, (pair % most - 1).astype(np.int32)
                with_terms, size = np.unique(doc, return_counts=True)
                seen, df = np.unique(term, return_counts=True)
                no_id = part.column(0).is_null().to_numpy(zero_copy_only=False)[with_terms]
                doc_id = part.column(0).fill_null(0).to_numpy()[with_terms]
                packed = (doc_id.astype("<i8"), no_id.astype("u1"), n[with_terms].astype("<i8"), size.astype("<i4"), term.astype("<i4"), tf.astype("<i4"))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                    pa.array([[{"term": t, "n": c} for t, c in zip(seen.tolist(), df.tolist())]], pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))),
                    *(pa.array([x.tobytes()], pa.binary()) for x in packed)],
                    names=["docs", "terms", "df", "ids", "no_id", "n", "size", "term", "tf"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, GROUP)


class Query:
    """One item: its terms and their weights times their repeats."""

    def __init__(self, key: int, terms: np.ndarray, weight: np.ndarray):
        by = np.argsort(terms)
        self.key, self.terms, self.weight = key, terms[by], weight[by]


class Best:
    """The k best (score, document id) of one item; null ids come last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.no_id, self.doc = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, no_id: np.ndarray, doc: np.ndarray) -> None:
        some = score >= max(1, self.least)
        score, no_id, doc = (np.concatenate([old, new[some]]) for old, new in ((self.score, score), (self.no_id, no_id), (self.doc, doc)))
        by = np.lexsort((doc, no_id, -score))[: self.k]
        self.score, self.no_id, self.doc = score[by], no_id[by], doc[by]

    @property
    def least(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0


class Shard:
    """Impact lists of a shard of documents, and each document's own postings for direct access."""

    def __init__(self, groups: list[dict], n_terms: int, n_docs: int, n_words: int):
        read = lambda name, kind: np.concatenate([np.frombuffer(g[name], kind) for g in groups])
        self.doc_id, self.no_id = read("ids", "<i8"), read("no_id", "u1").astype(bool)
        n, size = read("n", "<i8"), read("size", "<i4").astype(np.int64)
        self.term, tf = read("term", "<i4"), read("tf", "<i4").astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        m = np.array([75 + 25 * int(x) * n_docs // n_words for x in n], np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        by = np.argsort(self.term.astype(np.int64) << 21 | (1_000_000 - self.impact), kind="stable")
        self.list_doc, self.list_impact = doc[by], self.impact[by]
        self.position = np.empty(len(by), np.int64)
        self.position[by] = np.arange(len(by))
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=n_terms))])
        self.seen, self.met, self.slot = np.zeros(len(by), bool), np.zeros(len(size), bool), np.full(n_terms, -1)

    def search(self, q: Query, best: Best) -> int:
        """Best Position Algorithm for one item; returns how many documents were accessed."""
        begin, end = self.lists[q.terms], self.lists[q.terms + 1]
        some = end > begin
        begin, end, weight = begin[some], end[some], q.weight[some]
        self.slot[q.terms[some]] = np.arange(len(begin))
        at = begin.copy()  # the first unseen position of each list; the best position is the one before it
        marked, accessed, step = [], [], FIRST_STEP
        while (at < end).any():
            upto = np.minimum(at + step, end)
            length = upto - at
            place = np.repeat(at - np.cumsum(length) + length, length) + np.arange(length.sum())
            docs = np.unique(self.list_doc[place])
            docs = docs[~self.met[docs]]
            self.seen[place] = True
            marked.append(place)
            if len(docs):
                self.met[docs] = True
                accessed.append(docs)
                size = self.begin[docs + 1] - self.begin[docs]
                own = np.repeat(self.begin[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())
                slot = self.slot[self.term[own]]
                row = np.repeat(np.arange(len(docs)), size)[slot >= 0]
                own, slot = own[slot >= 0], slot[slot >= 0]
                self.seen[self.position[own]] = True
                marked.append(self.position[own])
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                best.add(np.add.reduceat(weight[slot] * self.impact[own], first), self.no_id[docs], self.doc_id[docs])
            at = upto
            for i in np.flatnonzero(at < end).tolist():  # best positions advance over what direct accesses have seen
                ahead = self.seen[at[i] : end[i]]
                gap = int(ahead.argmin())
                at[i] = end[i] if ahead[gap] else at[i] + gap
            threshold = int((weight * np.where(at < end, self.list_impact[at - 1], 0)).sum())
            if threshold < best.least or not threshold:
                break
            step *= 2
        for x in marked:
            self.seen[x] = False
        for x in accessed:
            self.met[x] = False
        self.slot[q.terms] = -1
        return sum(map(len, accessed))


def _rank_block(groups: DataFrame, queries: list[tuple[int, list[int], list[int]]], weights: list[int], n_docs: int, n_words: int, k: int) -> DataFrame:
    """At most k rows (key, score, no_id, doc_id) an item and task."""
    weight = np.array(weights, np.int64)
    made = [Query(key, np.array(t, np.int64), np.array(times, np.int64) * weight[t]) for key, t, times in queries]
    block = groups.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        held, size = [], 0

        def search():
            shard = Shard(held, len(weight), n_docs, n_words)
            for q in block.value:
                shard.search(q, best.setdefault(q.key, Best(k)))

        for batch in batches:
            for i in range(batch.num_rows):
                held.append({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)})
                size += len(held[-1]["term"]) // 4
                if size >= SHARD_POSTINGS:
                    search()
                    held, size = [], 0
        if size:
            search()
        for key, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(b.score), pa.int64()), pa.array(b.score), pa.array(b.no_id), pa.array(b.doc)],
                                             names=["key", "score", "no_id", "doc_id"])

    return map_arrow(groups.select("ids", "no_id", "n", "size", "term", "tf"), run, "key long, score long, no_id boolean, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", most_terms: int = 200_000) -> DataFrame:
    """The k documents of highest score above 0 for each item: ``item_col``, rank, ``id_col``, score."""
    spark = docs.sparkSession
    terms = cut_lineage(terms_of(items, item_col, item_text_col), "query-terms")
    blocks = max(1, -(-terms.count() // most_terms))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    found = spark.createDataFrame([], "key long, score long, no_id boolean, doc_id long")
    for b in range(blocks):
        known: dict[str, int] = {}
        asked: dict[int, tuple[list[int], list[int]]] = {}
        for r in terms.where(F.col("block") == b).select("key", "term", "times").toLocalIterator():
            t, times = asked.setdefault(r.key, ([], []))
            t.append(known.setdefault(r.term, len(known)))
            times.append(r.times)
        groups = cut_lineage(postings(docs, id_col, text_col, known), "postings")
        total = groups.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
        if not total.terms or not asked:
            continue
        df = {r.term: r.n for r in groups.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.n").alias("n")).toLocalIterator()}
        weights = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(known))]
        found = found.unionByName(_rank_block(groups, [(q, *x) for q, x in asked.items()], weights, total.docs, total.terms, k))
    order = [F.col("score").desc(), "no_id", "doc_id"]
    salted = W.partitionBy("key", "salt").orderBy(*order)
    some = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order))).where(F.col("rank") <= k)
    names = terms.select("key", F.col("item").alias(item_col)).distinct()
    return ranked.join(names, "key").select(item_col, "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias(id_col), "score")
