"""Operator 3: order-preserving packing of documents into windows of at most ``window`` tokens.

Each input partition is a stream of tokens, document after document. A dynamic program over the possible cuts (document
ends, sentence ends, and every 16th token inside a sentence of over 128 tokens) minimises padding plus truncation
penalties::

    best[j] = penalty[j] + min over i < j, at[j] - at[i] <= window of (best[i] + window - (at[j] - at[i]))

``best[i] + at[i]`` does not depend on j, so the minimum over the sliding range of i is kept by a monotone queue: every
cut enters and leaves it once. The stream is solved in blocks; the open end of a block (less than a window) opens the
next one, so that blocks cost no padding. What remains at the end of a partition is one padded window, or windows whose
lengths are powers of two (these need no padding), whichever costs less.

No row is shuffled and a task holds one block and one document. Sequence ids are unique over all partitions, not gapless.

Cases: a null or empty text is a document of one token (the end id); a document longer than a window is cut into several
pieces, each id lying in exactly one; repeated rows and repeated ids are packed one by one; an empty table gives an empty
table; columns other than the id and the text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from citeflow.llm.bpe_codec import vocabulary
from citeflow.llm.common import map_arrow, slices
from citeflow.llm.pretokens import WORD_PATTERN, library_encoder, shared_encoder

#: Tokens in a block of the dynamic program.
BLOCK = 1 << 19
SENTENCE_END = re.compile("[.!?…。！？]+[\"'”’»)\\]]*(</w>)?$")


def sentence_end_table(tokenizer_json: bytes) -> np.ndarray:
    """A flag for every id: its token ends a sentence."""
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    plain = ByteLevel()
    vocab = Tokenizer.from_str(tokenizer_json.decode()).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = bool(SENTENCE_END.search(token) or SENTENCE_END.search(plain.decode([token.removesuffix("</w>")])))
    return out


def possible_cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int,
                  sentence_penalty: float, token_penalty: float, long_sentence: int = 128,
                  step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut places in [0, total] and the penalty of each; no two neighbours are over a window apart."""
    cost = np.full(total + 1, np.inf, np.float32)
    cost[sentence_ends] = sentence_penalty
    cost[doc_ends] = 0.0
    cost[0] = 0.0
    ends = np.append(np.flatnonzero(np.isfinite(cost)), total)
    for g in np.flatnonzero(np.diff(ends) > min(long_sentence, window)).tolist():
        inner = cost[ends[g] + step : ends[g + 1] : step]
        inner[:] = np.minimum(inner, token_penalty)
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places].astype(np.float64)


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of windows that end exactly at each cut, and the cut before it (monotone queue, one pass)."""
    places, fine = at.tolist(), penalty.tolist()
    n = len(places)
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0 + places[0], 0, places[0])])
    for j in range(1, n):
        p = places[j]
        while queue[0][2] < p - window:
            queue.popleft()
        key, i, _ = queue[0]
        cost = key + window - p + fine[j]
        best[j], back[j] = cost, i
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, p))
    return np.array(best), np.array(back)


def tail_lengths(rest: int, window: int, short_penalty: float) -> list[int]:
    """How the last ``rest`` (at most ``window``) tokens are laid out: one padded window or powers of two."""
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    if not rest or rest == window or window - rest <= short_penalty * len(powers):
        return [rest] if rest else []
    return powers


def tail_cost(rest: int, window: int, short_penalty: float) -> float:
    return 0.0 if rest in (0, window) else min(window - rest, short_penalty * rest.bit_count())


class Packer:
    """Windows of one stream. ``feed`` takes a document; both ``feed`` and ``close`` yield finished pieces
    ``(document number, start in the document, window number, offset in the window, ids)``."""

    def __init__(self, window: int, sentence_ends: np.ndarray, sentence_penalty: float = 16.0,
                 token_penalty: float = 64.0, short_penalty: float = 16.0, block: int = BLOCK):
        self.window, self.is_end, self.block = window, sentence_ends, block
        self.sentence_penalty, self.token_penalty, self.short_penalty = sentence_penalty, token_penalty, short_penalty
        self.parts: list[tuple[int, int, np.ndarray]] = []  # document number, its ids before this part, ids
        self.held = self.docs = self.windows = 0

    def feed(self, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.parts.append((self.docs, at, part))
            self.held += len(part)
            if self.held >= self.block:
                yield from self._solve(False, at + len(part) == len(ids))
        self.docs += 1

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._solve(True, True)

    def _solve(self, last: bool, ended: bool) -> Iterator[tuple]:
        ids = np.concatenate([p for _, _, p in self.parts])
        ends = np.cumsum([len(p) for _, _, p in self.parts])
        total = int(ends[-1])
        at_doc_end = np.append(np.array([a[0] != b[0] for a, b in zip(self.parts, self.parts[1:])], bool), ended)
        known = ids < len(self.is_end)
        sentences = np.flatnonzero(known & self.is_end[np.where(known, ids, 0)]) + 1
        at, penalty = possible_cuts(total, ends[at_doc_end], sentences, self.window, self.sentence_penalty, self.token_penalty)
        best, back = best_cuts(at, penalty, self.window)
        first = int(np.searchsorted(at, total - self.window))
        if last:
            ending = best[first:] + [tail_cost(total - int(a), self.window, self.short_penalty) for a in at[first:]]
        else:
            ending = best[first:]  # the open end costs nothing yet
        j = first + int(np.argmin(ending))
        done, cuts = int(at[j]), []
        while j:
            cuts.append(int(at[j]))
            j = int(back[j])
        cuts = [0, *cuts[::-1]]
        if last:
            for n in tail_lengths(total - done, self.window, self.short_penalty):
                cuts.append(cuts[-1] + n)
            done = total
        edges = np.union1d(cuts, ends[ends < done]) if done else np.array([0])
        edges = edges.astype(np.int64)
        begins = np.append(0, ends[:-1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            k = int(np.searchsorted(begins, a, "right")) - 1
            w = int(np.searchsorted(cuts, a, "right")) - 1
            doc, before, _ = self.parts[k]
            yield doc, before + a - int(begins[k]), self.windows + w, a - cuts[w], ids[a:b]
        self.windows += len(cuts) - 1
        rest = []
        for (doc, before, part), b in zip(self.parts, begins.tolist()):
            if b + len(part) > done:
                skip = max(0, done - b)
                rest.append((doc, before + skip, part[skip:]))
        self.parts, self.held = rest, total - done


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id",
         text_col: str = "text", **penalties: float) -> DataFrame:
    """Pieces of packed sequences: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    ``path`` is the word tokenizer's file. Pieces of one sequence follow one another from offset 0 without gaps.
    """
    blob = vocabulary(docs.sparkSession, path)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([df.schema["id"]] + [T.StructField(n, T.LongType(), False) for n in
                          ("start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType(), False)])

    ends = sentence_end_table(blob.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder("word", blob.value, lambda: library_encoder(blob.value, WORD_PATTERN, True))
        packer = Packer(window, ends, **penalties)
        base = TaskContext.get().partitionId() << 40
        meta: dict[int, tuple] = {}  # open documents only
        id_type, rows, size = None, [], 0

        def flush():
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def take(pieces):
            nonlocal size
            for doc, start, w, offset, ids in pieces:
                key, n = meta[doc]
                rows.append((key, start, len(ids), n, base + w, offset, ids.astype("<u4").tobytes()))
                size += 4 * len(ids)
                if start + len(ids) == n:
                    del meta[doc]

        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text), np.int32(end_id))
                    meta[packer.docs] = (key, len(ids))
                    take(packer.feed(ids))
                    if size > 4 << 20:
                        yield flush()
                        rows, size = [], 0
        take(packer.close())
        if rows:
            yield flush()

    out = map_arrow(df, run, schema, keeps_table=True)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
