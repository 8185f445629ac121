"""Operator 2: quality classifier by supervised subword embeddings.

Every word and every character 3- to 5-gram of ``<word>`` has a learned vector, found by a hash. A document is the average
of all these vectors; a softmax over two classes reads it. Vectors and output are trained together by stochastic gradient
descent in numpy.

A word that follows itself, or a line that stands in the text already, is also counted as the word ``<again>``: a learned
vector like any other, which lets the average see repetition.

Training uses every labelled document. Each is a bag of hashed features, made on the executors, dealt by a hash of its id to parts of
about ``PART_ROWS`` documents, and written once, packed, to the shared folder. Documents and labels meet in one shuffle by the part. In an
epoch every part descends from the common weights over all its bags, and the parts' weights are averaged: a bucket's over the parts that met
it. A task adds up ``GROUP`` neighbouring parts, whose bags are one file, so few sums are shuffled; these are added ``FAN_IN`` at a time on
the executors, and that many, each as large as the model, reach the driver at most. The number of epochs falls with the number of parts, not
below ``LEAST_EPOCHS``; each goes over all documents. Parts and their order follow ids and texts, not the partitions that are read.

Words are kept in a bounded table with their buckets (scoring: with one number and one count), so a document costs a lookup a word. The
n-grams of all words that the table lacks are hashed together, in runs of ``RUN_CHARS`` characters of text.

Cases: a null or empty text has no features and gets the score of the offset alone; long texts are read whole; a document
labelled twice counts with its lowest label, labels with nulls are ignored; without labels of both classes every score is
0.5 (or the one class's prior); empty tables give empty results. All columns are kept; ``score`` must not be among them.
"""

from __future__ import annotations

import copy
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import drop_stage, map_arrow, map_texts, scratch_path

BUCKETS = 1 << 17
#: Documents of a part that descends by itself within an epoch, and sums that the driver adds up at most.
PART_ROWS, FAN_IN = 2048, 16
#: Neighbouring parts that a task adds up. Characters of text, and texts, whose words are looked up together.
GROUP, RUN_CHARS, RUN_TEXTS = 4, 1 << 18, 4096
#: New words hashed together at most.
ADD_WORDS = 1 << 15
#: Passes over all documents: ``EPOCHS`` for one part or less, fewer the more parts there are.
EPOCHS, LEAST_EPOCHS = 10, 3
GRAMS = (3, 4, 5)
AGAIN = "<again>"


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    out = [zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS]
    marked = f"<{word}>"
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n].encode("utf-8", "replace"), n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def words_of(text: str):
    """Words of a text, with ``<again>`` after a word that repeats the one before and for each line seen before."""
    seen: set[int] = set()
    for line in text.split("\n"):
        words = line.split()
        if words:
            yield words
            again = sum(map(eq, words, words[1:]))
            h = hash(line)
            if h in seen:
                again += len(words)
            seen.add(h)
            if again:
                yield [AGAIN] * again


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()
#: What a start from ``n`` adds to the state from 0 after so many bytes (CRC-32 is linear), and the lead bytes of UTF-8 by length.
START = {n: np.array([zlib.crc32(bytes(b), n) for b in range(4 * n + 1)], np.uint32) for n in GRAMS}
LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words, one after another, and where each word's end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    chars = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "replace") + bytes(4 * max(GRAMS)), "<u4")
    n_bytes = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    left = np.repeat(first + sizes, sizes) - np.arange(n)  # characters to the word's end
    found, there = np.empty((n, 1 + len(GRAMS)), np.uint32), np.zeros((n, 1 + len(GRAMS)), bool)
    found[first, 0], there[first, 0] = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint32, len(words)), True
    leads, state, total = LEAD[n_bytes] | chars >> 6 * (n_bytes - 1), np.zeros(n, np.uint32), np.zeros(n, np.int64)
    for k in range(1, max(GRAMS) + 1):  # the state after k characters, at every character
        state = CRC[(state ^ leads[k - 1 : k - 1 + n]) & 0xFF] ^ state >> 8
        for j in (1, 2, 3):
            at = np.flatnonzero(n_bytes[k - 1 : k - 1 + n] > j)
            byte = 0x80 | chars[at + k - 1] >> 6 * (n_bytes[at + k - 1] - 1 - j) & 0x3F
            state[at] = CRC[(state[at] ^ byte) & 0xFF] ^ state[at] >> 8
        total += n_bytes[k - 1 : k - 1 + n]
        if k in GRAMS:
            found[:, GRAMS.index(k) + 1], there[:, GRAMS.index(k) + 1] = state ^ START[k][total], left >= k
    return (found[there] % BUCKETS).astype(np.int32), np.cumsum(there.sum(1))[first + sizes - 1]


class WordTable(dict):
    """Word -> row. Once it holds more than ``max_words`` it starts anew, so memory is bounded; long words are not kept."""

    def __init__(self, max_words: int = 100_000):
        super().__init__()
        self.max_words, self.n = max_words, 0
        self.reset()

    def reset(self) -> None:
        """Forget all rows."""

    def add(self, flat: np.ndarray, ends: np.ndarray) -> None:
        """Rows of new words, from their features and where each word's end."""

    def rows(self, words: list[str]) -> np.ndarray:
        if self.n > self.max_words:
            self.clear()
            self.n = 0
            self.reset()
        new = [w for w in dict.fromkeys(words) if w not in self]
        for i in range(0, len(new), ADD_WORDS):
            self.add(*features_of(new[i : i + ADD_WORDS]))
        self.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > 64:
                del self[w]
        return out


def runs(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of neighbouring texts, about ``RUN_CHARS`` characters together, and how many words each text has."""
    words, sizes, chars = [], [], 0
    for t in texts:
        if sizes and (chars + len(t or "") > RUN_CHARS or len(sizes) == RUN_TEXTS):
            yield words, np.array(sizes)
            words, sizes, chars = [], [], 0
        before = len(words)
        words.extend(chain.from_iterable(words_of(t or "")))
        sizes.append(len(words) - before)
        chars += len(t or "")
    if sizes:
        yield words, np.array(sizes)


class Bagger(WordTable):
    """Bags of texts; the table holds the buckets of words."""

    def reset(self) -> None:
        self.flat, self.ends = array("i"), array("q", [0])

    def add(self, flat: np.ndarray, ends: np.ndarray) -> None:
        ends = ends + len(self.flat)
        self.flat.frombytes(flat.astype(np.int32).tobytes())
        self.ends.frombytes(ends.astype(np.int64).tobytes())

    def bags(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct buckets of each text, ascending, and how often each occurs."""
        for words, sizes in runs(texts):
            rows = self.rows(words)
            keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (self.n + 1) + rows, return_counts=True)
            who, rows = np.divmod(keys, self.n + 1)
            begin, end = (np.frombuffer(self.ends, np.int64)[rows + i] for i in (0, 1))
            at = np.repeat(end - np.cumsum(end - begin), n := end - begin) + np.arange(n.sum())
            keys = np.repeat(who << 49 | times, n) | np.frombuffer(self.flat, np.int32)[at].astype(np.int64) << 32
            keys.sort()
            start = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
            times = np.add.reduceat(keys & 0xFFFFFFFF, start) if len(start) else keys
            keys = keys[start] >> 32
            cut = np.searchsorted(keys, np.arange(1, len(sizes)) << 17)
            yield from zip(np.split((keys & BUCKETS - 1).astype(np.int32), cut), np.split(times.astype(np.float32), cut))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    return next(Bagger().bags([text]))


class SubwordModel:
    """Embeddings of all buckets and a two-class softmax."""

    def __init__(self, dim: int = 8, seed: int = 11):
        r = np.random.default_rng(seed)
        self.e = r.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        self.w = np.zeros((dim, 2), np.float32)
        self.offset = 0.0
        self.prior = 0.0

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weight: np.ndarray, done: float = 0.0, share: float = 1.0,
            batch: int = 8, rate: float = 1.0, seed: int = 11):
        """One pass of stochastic gradient descent on the cross entropy over all ``bags``: the ``share`` of the whole training that
        follows after ``done``, in which the rate falls to zero. ``weight`` has the weights of the two classes."""
        order, y = np.random.default_rng(seed).permutation(len(bags)), np.asarray(labels)
        whole = self.e.view(np.dtype((np.void, self.e.itemsize * self.e.shape[1])))[:, 0]  # vectors as single values: set faster
        for at in range(0, len(order), batch):
            pick = [i for i in order[at : at + batch] if len(bags[i][0])]
            if pick:
                ids = np.concatenate([bags[i][0] for i in pick])
                part = np.concatenate([bags[i][1] / bags[i][1].sum() for i in pick])
                begin = np.cumsum([0] + [len(bags[i][0]) for i in pick])[:-1]
                h = np.add.reduceat(self.e.take(ids, 0) * part[:, None], begin, axis=0)
                z = h @ self.w + np.array([0, self.offset], np.float32)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p *= weight[y[pick]][:, None]
                now = np.float32(rate * (1 - done - share * at / len(order)))
                back = p @ self.w.T
                self.w -= now * h.T @ p
                self.offset -= float(now * 0.1 * p[:, 1].sum())
                for i, one, n in zip(pick, back, np.split(part, begin[1:])):  # a bag holds a bucket once
                    moved = one * n[:, None]
                    moved *= now * 20
                    np.subtract(self.e.take(bags[i][0], 0), moved, out=moved)
                    whole[bags[i][0]] = moved.view(whole.dtype)[:, 0]
        return self

    def set_prior(self, good: int, bad: int):
        """The classes weigh the same in training; scores follow their share among all labelled rows."""
        self.prior = float(np.log(max(good, 0.5) / max(bad, 0.5)))
        return self

    def bucket_scores(self) -> np.ndarray:
        return (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float64)


class Scorer(WordTable):
    """Scores of texts; the table holds the summed score of a word's features and their number."""

    def __init__(self, per_bucket: np.ndarray, offset: float, prior: float, max_words: int = 100_000):
        super().__init__(max_words)
        self.per_bucket, self.offset, self.prior = per_bucket, offset, prior

    def reset(self) -> None:
        self.total, self.count = array("d"), array("d")

    def add(self, flat: np.ndarray, ends: np.ndarray) -> None:
        self.total.frombytes(np.add.reduceat(self.per_bucket[flat], np.append(0, ends[:-1])).tobytes())
        self.count.frombytes(np.diff(ends, prepend=0).astype(np.float64).tobytes())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.empty(0)]
        for words, sizes in runs(texts):
            rows, who = self.rows(words), np.repeat(np.arange(len(sizes)), sizes)
            total, count = (np.bincount(who, np.frombuffer(x)[rows], len(sizes)) if len(words) else np.zeros(len(sizes)) for x in (self.total, self.count))
            z = total / np.maximum(count, 1) + self.offset + self.prior
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return np.concatenate(out)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


SUMS = "part long, n long, e binary, met binary, w binary, offset double"
#: Documents of a written row of bags.
ROW_BAGS = 256


def packed(values: np.ndarray) -> bytes:
    """Small whole numbers, byte by byte of their 32 bits, so that compression finds the zeros together: length and data. It is
    compressed here, since Spark holds all rows of a file at once when it reads them."""
    data = values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    plain = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def _row_of(part: int, held: list[tuple]) -> pa.RecordBatch:
    """Bags (buckets, counts, label) as one row; of the buckets, the gaps between them are written."""
    sizes, at = np.array([len(h[0]) for h in held]), np.concatenate([h[0] for h in held])
    gaps, first = np.diff(at, prepend=0), (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[first] = at[first]
    cols = {"labels": np.array([h[2] for h in held]), "sizes": sizes, "gaps": gaps, "counts": np.concatenate([h[1] for h in held])}
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{c: pa.array([packed(v)], pa.binary()) for c, v in cols.items()}})


def _labelled_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, id, label, text), sorted, an id's label before its documents, as packed rows of bags: of an id that documents
    repeat the first is taken, documents without a label are passed over."""
    bagger, now, wanted, label = Bagger(), None, None, None
    held, texts, labels, chars = [], [], [], 0
    for batch in batches:
        for i, (part, key, given) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if given is not None:
                wanted, label = (part, key), given
            elif wanted == (part, key):
                if texts and (part != now or chars > RUN_CHARS):
                    held += [(*b, y) for b, y in zip(bagger.bags(texts), labels)]
                    texts, labels, chars = [], [], 0
                if held and (part != now or len(held) >= ROW_BAGS):
                    yield _row_of(now, held)
                    held = []
                texts.append(batch.column(3)[i].as_py())
                labels.append(label)
                now, wanted, chars = part, None, chars + len(texts[-1] or "")
    held += [(*b, y) for b, y in zip(bagger.bags(texts), labels)]
    if held:
        yield _row_of(now, held)


def _bags_of(row: dict) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    sizes, at = unpacked(row["sizes"]), np.cumsum(unpacked(row["gaps"]), dtype=np.int64)
    ends = np.cumsum(sizes)
    at -= np.repeat(np.append(0, at)[ends - sizes], sizes)
    bags = zip(np.split(at.astype(np.int32), ends[:-1]), np.split(unpacked(row["counts"]).astype(np.float32), ends[:-1]))
    return list(bags), unpacked(row["labels"]).tolist()


def _sum_row(part: int, n: int, e: np.ndarray, met: np.ndarray, w: np.ndarray, offset: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "n": [n], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("e", e), ("met", met), ("w", w))}, "offset": [offset]})


def _plus(total: list | None, more: list) -> list:
    return more if total is None else [a + b for a, b in zip(total, more)]


def _added(total: list | None, r: dict) -> list:
    """A sum of parts with one more: documents, vectors of the buckets, parts that met a bucket, output, offset."""
    return _plus(total, [r["n"], np.frombuffer(r["e"], np.float32), np.frombuffer(r["met"], np.int32), np.frombuffer(r["w"]), r["offset"]])


def _fewer(sums: DataFrame) -> DataFrame:
    """``FAN_IN`` neighbouring sums added to one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if total is not None and r["part"] // FAN_IN != now:
                    yield _sum_row(now, *total)
                    total = None
                now, total = r["part"] // FAN_IN, _added(total, r)
        if total is not None:
            yield _sum_row(now, *total)

    return map_arrow(sums.repartition((F.col("part") / FAN_IN).cast("long")).sortWithinPartitions("part"), run, SUMS)


def _epoch(bags: DataFrame, parts: int, model: SubwordModel, weight: np.ndarray, done: float, share: float, seed: int) -> None:
    """``model`` after one more epoch: every part's descent from it, averaged. A group's parts are added where they descend."""
    sent = bags.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(total: list | None) -> list:
            mine = copy.deepcopy(sent.value).fit(rows, labels, weight, done, share, seed=seed)
            met = np.zeros(BUCKETS, np.int32)
            for at, _ in rows:
                met[at] = 1
            return _plus(total, [len(rows), (mine.e * met[:, None].astype(np.float32)).ravel(), met, mine.w.ravel().astype(np.float64) * len(rows), mine.offset * len(rows)])

        now, rows, labels, total = None, [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now and rows:
                    total = one(total)
                    rows, labels = [], []
                    if row["part"] // GROUP != now // GROUP:
                        yield _sum_row(now // GROUP, *total)
                        total = None
                now, more = row["part"], _bags_of(row)
                rows, labels = rows + more[0], labels + more[1]
        if rows:
            yield _sum_row(now // GROUP, *one(total))

    sums, most = map_arrow(bags, run, SUMS), -(-parts // GROUP)
    while most > FAN_IN:
        sums, most = _fewer(sums), -(-most // FAN_IN)
    total = None
    for r in sorted(sums.collect(), key=lambda r: r["part"]):
        total = _added(total, r.asDict())
    sent.destroy()
    n, e, met, w, offset = total
    seen = met > 0
    model.e[seen] = e.reshape(model.e.shape)[seen] / met[seen, None]
    model.w, model.offset = (w / n).reshape(model.w.shape).astype(np.float32), offset / n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          dim: int = 8) -> SubwordModel:
    """``labels``: the id and 0/1. All rows given here, and only these, are learnt from. All ``docs`` are shuffled: leave out what no label is for."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    model = SubwordModel(dim).set_prior(shares.get(1, 0), shares.get(0, 0)) if shares else SubwordModel(dim)
    if len(shares) < 2:
        return model
    parts = -(-sum(shares.values()) // PART_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id is not null").unionByName(known.withColumn("text", F.lit(None).cast("string")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartitionById(-(-parts // GROUP), F.expr(f"part div {GROUP}").cast("int"))
    rows = rows.sortWithinPartitions("part", F.xxhash64("id"), "id", F.col("label").isNull(), F.xxhash64("text"))
    path = scratch_path(spark, "quality_bags")
    schema = "part int, labels binary, sizes binary, gaps binary, counts binary"
    map_arrow(rows.select("part", "id", "label", "text"), _labelled_bags, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    try:
        if not written.isEmpty():
            weight = np.array([0.5 * sum(shares.values()) / shares[c] for c in (0, 1)], np.float32)
            epochs = max(LEAST_EPOCHS, -(-EPOCHS // parts))
            for i in range(epochs):
                _epoch(written, parts, model, weight, i / epochs, 1 / epochs, seed=11 + i)
    finally:
        drop_stage(spark, path)
    return model


def score(docs: DataFrame, model: SubwordModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``score``: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.offset, model.prior))  # one number a bucket

    def make():
        scorer = Scorer(*sent.value)
        return lambda texts: [pa.array(scorer.scores(texts), pa.float64())]

    return map_texts(docs, text_col, "score double", make)
