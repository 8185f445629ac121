"""Words shared by the phrase and ranking operators: ASCII letters (lower-cased), ASCII digits and all bytes from 0x80 on.

In valid UTF-8 that is the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z were lower-cased. Texts are
taken as bytes: one table lookup a byte folds the letters and turns every separator into a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa


def _folded(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 0x20
    return b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20


FOLD = bytes(map(_folded, range(256)))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; nulls are empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_ids(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words of all texts one after another, words of each text); words that are not ``known`` have id 0."""
    lists = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(known.get, chain.from_iterable(lists), repeat(0)), np.int32, int(counts.sum())), counts


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte begins and ends of the words of one text."""
    inside = np.frombuffer(data.translate(FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def windows_of(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    """All runs of ``size`` consecutive words; a shorter list that is not empty is one window."""
    for i in range(max(min(1, len(words)), len(words) - size + 1)):
        yield words[i : i + size]
