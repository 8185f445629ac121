"""Operator 11: benchmark decontamination by an FM-index per shard of training documents.

A test item's phrases are its windows of ``window`` consecutive words (an item of fewer words is one phrase). A document
word inside any occurrence of a phrase is hit.

Plan. No row is shuffled. Every task cuts its documents into shards of bounded size and indexes them one after another:

1. Words that no phrase has become separators, and what stands between separators is indexed if it is at least as long
   as the shortest phrase. That is exact, since an occurrence holds phrase words only, and it keeps the index small.
2. The suffix array of the shard (prefix doubling, later rounds sort open groups only) gives the Burrows-Wheeler
   transform, which a wavelet matrix over word ids holds with a popcount directory.
3. All phrases are searched backward at once, two wavelet ranks a word; phrases with empty ranges leave.
4. Occurrences are located by steps back to the next sampled suffix position (every ``SAMPLE`` words and each beginning).
5. Spans of a document are merged, and counted and given as byte spans for removal.

The phrases are broadcast in blocks of at most about ``most_phrases`` (phrase, item) pairs, dealt by hash so that neither
a phrase of many items nor a very long item makes a block large. More blocks mean more passes, each merging its spans
into what the passes before it found.

Cases: a null or empty text has no words; a text without words has no phrases and no hits; long texts are indexed whole;
repeated documents are searched each, repeated items count once an id; items without an id hit words but are not counted;
empty tables give no hits and no rows. All columns but the text are kept; one with the name of an added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.common import cut_lineage, map_arrow, slices
from citeflow.llm.words import texts_of, windows_of, word_ids, word_places, words_of

#: Words of a shard's index (a longer document is a shard of its own), and bytes of text a task holds for one shard.
SHARD_WORDS = 1 << 20
SHARD_BYTES = 32 << 20
SAMPLE = 8
ADDED = ("n_words", "n_hit", "spans", "items")
SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


class RankBits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbols by bit planes, most significant first; every plane is the one before it with zeros moved to the front."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.width = max(1, int(most).bit_length())
        self.planes, self.zeros = [], []
        now = symbols
        for b in reversed(range(self.width)):
            bits = (now >> b & 1).astype(bool)
            self.planes.append(RankBits(bits))
            self.zeros.append(len(now) - int(bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])
        every = np.arange(most + 1)
        self.begin = self._down(every, np.zeros(most + 1, np.int64))

    def _step(self, level: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = self.planes[level].ones(i)
        return np.where(bit, self.zeros[level] + ones, i - ones)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.width):
            i = self._step(level, (symbol >> (self.width - 1 - level) & 1).astype(bool), i)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._down(symbol, i) - self.begin[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbol at place i, how often it stands before i)"""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.width):
            bit = self.planes[level].get(i)
            symbol = symbol << 1 | bit
            i = self._step(level, bit, i)
        return symbol, i - self.begin[symbol]


def by_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys below 2**bits; keys are packed with their places where 63 bits hold both."""
    place = max(1, len(keys).bit_length())
    if bits + place > 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << place | np.arange(len(keys))) & ((1 << place) - 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, which ends with a 0. Zeros are separators: each is a symbol of its own, less
    than all words and ordered by place, so no comparison goes beyond one."""
    n = len(text)
    width = n.bit_length()
    apart = text == 0
    first = np.where(apart, np.cumsum(apart) - 1, apart.sum() + text.astype(np.int64) - 1)
    order = by_keys(first, int(first.max()).bit_length())
    new = np.append(True, np.diff(first[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(open_):
        here = order[open_]
        key = rank[here] << width | rank[here + step]
        by = by_keys(key, 2 * width)
        here, key = here[by], key[by]
        order[open_] = here
        new = np.append(True, key[1:] != key[:-1])
        rank[here] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Index of a text of word ids in 1..``most`` with 0 as separator (the last symbol is one)."""

    def __init__(self, text: np.ndarray, most: int):
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        apart = np.flatnonzero(np.append(True, text[:-1] == 0))  # begins between separators
        step = np.arange(len(text)) - np.repeat(apart, np.diff(np.append(apart, len(text))))
        sampled = (step % SAMPLE == 0)[order]
        self.sampled, self.places = RankBits(sampled), order[sampled]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, begin, end) of the suffix ranges of all phrases that occur; ``phrases`` are rows filled with 0."""
        live = np.arange(len(phrases))
        last = phrases[live, lengths - 1]
        lo, hi = self.first[last], self.first[last + 1]
        done: list[tuple[np.ndarray, ...]] = []
        for back in range(1, phrases.shape[1] + 1):
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            end = lengths[live] < back + 1
            done.append((live[end], lo[end], hi[end]))
            live, lo, hi = live[~end], lo[~end], hi[~end]
            if not len(live):
                break
            word = phrases[live, lengths[live] - back - 1]
            lo, hi = (self.first[word] + self.bwt.rank(word, i) for i in (lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by steps back to sampled ones."""
        out, steps, which = np.empty(len(at), np.int64), 0, np.arange(len(at))
        while len(at):
            hit = self.sampled.get(at)
            out[which[hit]] = self.places[self.sampled.ones(at[hit])] + steps
            which, at = which[~hit], at[~hit]
            word, before = self.bwt.at(at)
            at = self.first[word] + before
            steps += 1
        return out

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text place) of all occurrences"""
        phrase, lo, hi = self.ranges(phrases, lengths)
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(phrase, n), self.locate(at)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint ones in ascending order (touching ones are joined)."""
    if not len(begin):
        return begin, end
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def without(text: bytes, spans: list[dict]) -> bytes:
    edges = [0, *(s[x] for s in spans for x in ("begin", "end")), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


class Phrases:
    """A block of (phrase, item) pairs as a task uses it."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        self.known: dict[bytes, int] = {}
        at: dict[bytes, int] = {}
        rows, self.items = [], []
        for text, item in pairs:
            phrase = text.encode()
            if phrase not in at:
                at[phrase] = len(rows)
                rows.append([self.known.setdefault(w, len(self.known) + 1) for w in phrase.split(b" ")])
                self.items.append([])
            if item is not None:
                self.items[at[phrase]].append(item)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.words = np.zeros((len(rows), max(map(len, rows), default=1)), np.int64)
        for i, r in enumerate(rows):
            self.words[i, : len(r)] = r
        self.least = int(self.lengths.min()) if rows else 0


class Shard:
    """Documents of one shard: their words as ids, later the spans and items found in them."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.size, self.bytes = phrases, [], 0, 0

    def add(self, texts: list[bytes]) -> None:
        ids, counts = word_ids(texts, self.phrases.known)
        ends = np.cumsum(counts)
        begins = ends - counts
        known = ids > 0
        new, over = known.copy(), known.copy()
        edge = np.append(begins, ends[-1:])
        inner = edge[(edge > 0) & (edge < len(ids))]
        new[1:] &= ~known[:-1]
        over[:-1] &= ~known[1:]
        new[inner], over[inner - 1] = known[inner], known[inner - 1]
        first, last = np.flatnonzero(new), np.flatnonzero(over) + 1
        enough = (last - first >= self.phrases.least) & (self.phrases.least > 0)
        first, last = first[enough], last[enough]
        doc = np.searchsorted(begins, first, "right") - 1
        runs = [np.append(ids[a:b], np.int32(0)) for a, b in zip(first.tolist(), last.tolist())]
        self.parts.append((counts, doc, first - begins[doc], runs))
        self.size += int((last - first + 1).sum())
        self.bytes += sum(map(len, texts))

    def found(self) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[set[str]]]]:
        """For each part: words of its documents, their merged word spans, and the items found in them."""
        base = np.cumsum([0] + [len(p[0]) for p in self.parts])
        doc = np.concatenate([p[1] + b for p, b in zip(self.parts, base)])
        word = np.concatenate([p[2] for p in self.parts])
        runs = [r for p in self.parts for r in p[3]]
        hits = np.empty((4, 0), np.int64)
        if runs:
            text = np.concatenate(runs)
            phrase, place = FMIndex(text, len(self.phrases.known)).occurrences(self.phrases.words, self.phrases.lengths)
            start = np.cumsum([0] + [len(r) for r in runs[:-1]])
            run = np.searchsorted(start, place, "right") - 1
            begin = word[run] + place - start[run]
            hits = np.stack([doc[run], phrase, begin, begin + self.phrases.lengths[phrase]])
            hits = hits[:, np.argsort(hits[0], kind="stable")]
        cuts = np.searchsorted(hits[0], np.arange(base[-1] + 1))
        d = 0
        for counts, *_ in self.parts:
            spans, items = [], []
            for _ in counts:
                mine = hits[:, cuts[d] : cuts[d + 1]]
                spans.append(merged(mine[2], mine[3]))
                items.append({x for p in np.unique(mine[1]).tolist() for x in self.phrases.items[p]})
                d += 1
            yield counts, spans, items


def phrases_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct (phrase, item) pairs of ``items``; a phrase is its words joined by spaces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                for item, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    made = list({b" ".join(w).decode() for w in windows_of(words_of(text), window)})
                    yield pa.RecordBatch.from_pydict({"phrase": pa.array(made, pa.string()), "item": pa.array([item] * len(made), pa.string())})

    return map_arrow(items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")), run, "phrase string, item string").distinct()


def _search_block(docs: DataFrame, text_col: str, pairs: list[tuple[str, str | None]], last: bool, cut: bool) -> DataFrame:
    """One pass over ``docs`` with one block; spans and items of earlier passes are in ``__cut`` and ``__in``."""
    block = docs.sparkSession.sparkContext.broadcast(Phrases(pairs))
    names = docs.columns
    at, earlier = names.index(text_col), "__cut" in names
    keep = [i for i, c in enumerate(names) if not (c in ("__cut", "__in") or last and i == at)]
    schema = T.StructType([docs.schema[i] for i in keep])
    if last:
        schema = schema.add("n_words", "long").add("n_hit", "long").add("spans", SPANS).add("items", T.ArrayType(T.StringType()))
        schema = schema.add(text_col, "string") if cut else schema
    else:
        schema = schema.add("__cut", T.ArrayType(T.LongType())).add("__in", T.ArrayType(T.StringType()))
    pair = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def done(batch: pa.RecordBatch, texts: list[bytes], counts, spans, items) -> pa.RecordBatch:
        if earlier:
            old = zip(*(batch.column(names.index(c)).to_pylist() for c in ("__cut", "__in")))
            both = [(merged(np.array([*b, *cut[::2]], np.int64), np.array([*e, *cut[1::2]], np.int64)), i.union(more))
                    for (b, e), i, (cut, more) in zip(spans, items, old)]
            spans, items = [x for x, _ in both], [x for _, x in both]
        listed = pa.array([sorted(i) for i in items], pa.list_(pa.string()))
        if not last:
            made = [pa.array([np.stack(s, 1).ravel().tolist() for s in spans], pa.list_(pa.int64())), listed]
        else:
            places = []
            for text, (b, e) in zip(texts, spans):
                first, end = word_places(text) if len(b) else (b, e)
                places.append([{"begin": x, "end": y} for x, y in zip(first[b].tolist(), end[e - 1].tolist())] if len(b) else [])
            made = [pa.array(counts), pa.array([int((e - b).sum()) for b, e in spans], pa.int64()), pa.array(places, pair), listed]
            if cut:
                made.append(pa.array([without(t, p).decode() for t, p in zip(texts, places)], pa.string()))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        held, shard = [], Shard(phrases)
        for batch in batches:
            for part in slices(batch, at):
                texts = texts_of(part.column(at))
                held.append((part, texts))
                shard.add(texts)
                if shard.size >= SHARD_WORDS - (SHARD_WORDS >> 3) or shard.bytes >= SHARD_BYTES:
                    for (b, t), found in zip(held, shard.found()):
                        yield done(b, t, *found)
                    held, shard = [], Shard(phrases)
        for (b, t), found in zip(held, shard.found()) if held else ():
            yield done(b, t, *found)

    return map_arrow(docs, run, schema)


def find(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", most_phrases: int = 200_000, cut: bool = False) -> DataFrame:
    """``docs`` without the text, with n_words, n_hit (hit words), spans (byte spans to remove, merged) and items (their
    ids as strings, sorted); with ``cut`` the text comes back last, without its spans."""
    added = {text_col.lower(), "__cut", "__in", *ADDED}
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], F.col(text_col).cast("string").alias(text_col))
    pairs = cut_lineage(phrases_of(items, window, item_col, item_text_col), "phrases")
    blocks = max(1, -(-pairs.count() // most_phrases))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)))
    for b in range(blocks):
        block = [(r.phrase, r.item) for r in pairs.where(F.col("block") == b).toLocalIterator()]
        df = _search_block(df, text_col, block, b == blocks - 1, cut)
        if b < blocks - 1:
            df = cut_lineage(df, "decontaminated")
    return df


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the words in occurrences of phrases cut out of their texts (a null text becomes an empty one)."""
    found = find(docs, items, text_col=text_col, cut=True, **options)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in ADDED])
