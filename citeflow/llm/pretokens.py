"""Encode whole texts piece by piece, each distinct piece once.

A space that stands between two non-space characters always starts a new pre-token in the public byte-level pattern,
and always ends one in the lower-casing word tokenizer, so a text can be cut there and the pieces encoded apart. Prose
repeats its pieces, so a bounded table of encoded pieces turns most of the work into one dictionary lookup a piece and
a numpy gather a text.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import regex

#: Unicode White_Space without U+0020.
OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0                　"
#: A space with white space on both sides (or at the end of the text): such runs must be split as a whole.
LOOSE_SPACE = re.compile(f" (?<=[ {OTHER_SPACE}] )(?=[ {OTHER_SPACE}]|\\Z)")
#: Punctuation that is a pre-token of its own after a word.
MARKS = frozenset(".,;:!?")
#: Characters worked on at a time; cuts fall on single spaces only.
SEGMENT = 1 << 20


def segments(text: str, size: int = SEGMENT) -> Iterator[tuple[bool, str]]:
    """(is the first, segment) pairs; the single space at a cut belongs to the segment that follows it."""
    begin, first = 0, True
    while len(text) - begin > size:
        cut = text.find(" ", begin + size)
        while cut >= 0 and (cut == begin or cut + 1 == len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield first, text[begin:cut]
        begin, first = cut + 1, False
    yield first, text[begin:]


class PieceEncoder(dict):
    """Piece (without the single space before it) -> row in flat arrays of ids.

    ``encode_piece(str) -> sequence of int`` encodes a piece *with* its space. Once ``max_pieces`` pieces or ``max_ids``
    ids are held the table starts anew, so memory is bounded and results do not depend on what it holds. A word with one
    mark after it is the word and the mark; words around a line break are both and the break between them (a single break
    is a pre-token of its own, or dropped); with ``lower`` (the tokenizer lower-cases) a word is its lower-case form.
    """

    def __init__(self, encode_piece: Callable, lower: bool = False, max_pieces: int = 900_000, max_ids: int = 8_000_000,
                 added: dict[str, int] | None = None):
        super().__init__()
        self.added = added or {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("|".join(map(re.escape, longest_first))).finditer if self.added else None
        self.added_start = os.path.commonprefix(longest_first)
        self.encode_piece, self.lower, self.max_pieces, self.max_ids = encode_piece, lower, max_pieces, max_ids
        self.marks = {m: list(encode_piece(m)) for m in MARKS}
        self.newline = list(encode_piece("\n"))
        self._reset()

    def __missing__(self, piece: str) -> int:
        line = self._line_break(piece)
        if line:
            ids = [*self._ids(piece[:line]), *self.newline, *self._after_break(piece[line + 1 :])]
        elif piece[-1:] in self.marks and piece[:-1].isalpha() and (not self.lower or self._stays_word(piece)):
            ids = [*self._ids(piece[:-1]), *self.marks[piece[-1]]]
        elif self.lower and piece.isascii() and piece.isalpha() and not piece.islower():
            ids = self._ids(piece.lower())
        else:
            ids = self.encode_piece(" " + piece)
        row = len(self.begin)
        self.begin.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        if len(piece) <= 64:
            self[piece] = row
        return row

    @staticmethod
    def _line_break(piece: str) -> int:
        """The place of a piece's only line break if it stands between characters that are not white space, else 0."""
        at = piece.find("\n")
        if at <= 0 or at + 1 == len(piece) or piece.find("\n", at + 1) > 0 or piece[at - 1].isspace() or piece[at + 1].isspace():
            return 0
        return at

    def _after_break(self, word: str) -> array:
        """Ids of what follows a line break, without a space before it."""
        if self.lower:
            return self._ids(word)
        if word not in self.bare:
            self.bare[word] = array("i", self.encode_piece(word))
        return self.bare[word]

    @staticmethod
    def _stays_word(piece: str) -> bool:
        """Normalising and lower-casing leave the letters letters (no combining mark appears before the mark)."""
        return piece.isascii() or (max(piece) < "ɐ" and "İ" not in piece)

    def _ids(self, piece: str) -> array:
        row = self[piece]
        return self.flat[self.begin[row] : self.begin[row] + self.count[row]]

    def _reset(self) -> None:
        self.clear()
        self.begin, self.count, self.flat = array("q"), array("q"), array("i")
        self.bare: dict[str, array] = {}

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        if len(self) + len(self.bare) > self.max_pieces or len(self.flat) > self.max_ids:
            self._reset()
        rows = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        n = np.frombuffer(self.count, np.int64)[rows]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int32)
        at = np.repeat(np.frombuffer(self.begin, np.int64)[rows] - ends + n, n)
        return np.frombuffer(self.flat, np.int32)[at + np.arange(ends[-1])]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids (int32) of one whole text; null and empty texts have none. The tokenizer's added tokens are ids of their own
        wherever they stand in a text, as in the library, and what is between them is encoded apart."""
        if not text:
            return np.empty(0, np.int32)
        if self.find_added and self.added_start in text:
            out, at = [], 0
            for m in self.find_added(text):
                out += [self._plain(text[at : m.start()]), np.array([self.added[m.group()]], np.int32)]
                at = m.end()
            return np.concatenate([*out, self._plain(text[at:])]) if out else self._plain(text)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        out = []
        for first, part in segments(text):
            if LOOSE_SPACE.search(part):
                out.append(np.asarray(self.encode_piece(part if first else " " + part), np.int32))
                continue
            pieces = part.split(" ")
            if first:
                out.append(np.asarray(self.encode_piece(pieces[0]) if pieces[0] else (), np.int32))
                pieces = pieces[1:]
            if pieces:
                out.append(self._pieces(pieces))
        return out[0] if len(out) == 1 else np.concatenate(out)


def byte_to_char() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_piece_encoder(tokenizer_json: bytes, pattern: str, lower: bool) -> Callable:
    """A function that encodes one piece with the ``tokenizers`` library (a piece holds no added token).

    Each pre-token goes to the library's model. ``lower`` is for the word tokenizer, whose normaliser composes (NFC)
    and lower-cases; pieces with characters above U+024F go through the library's whole chain, so that its own Unicode
    tables decide.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json.decode())
    model, alphabet = tok.model, byte_to_char()
    find, chars = regex.compile(pattern).findall, [alphabet[b] for b in range(256)]
    beyond = re.compile("[ɐ-\U0010ffff]").search
    space = "" if lower else chars[32]

    def encode_piece(piece: str) -> list[int]:
        body = piece[1:]
        if piece.isascii():
            if body.isalpha() and piece[0] == " ":  # one pre-token of characters that stand for themselves
                return [t.id for t in model.tokenize(space + (body.lower() if lower else body))]
        elif beyond(piece):
            return tok.encode(piece, add_special_tokens=False).ids
        if lower:
            piece = normalize("NFC", piece).lower()
        out: list[int] = []
        for word in find(piece):
            out.extend([t.id for t in model.tokenize("".join([chars[b] for b in word.encode()]))])
        return out

    return encode_piece


#: Fixed value: how the public word tokenizer splits a normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def added_tokens(tokenizer_json: bytes) -> dict[str, int]:
    """The added tokens of a tokenizer file: text -> id. Only plain ones are known here; others raise."""
    tokens = json.loads(tokenizer_json)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token of this tokenizer is not matched as it stands")
    return {t["content"]: t["id"] for t in tokens}


def library_encoder(tokenizer_json: bytes, pattern: str, lower: bool) -> PieceEncoder:
    return PieceEncoder(library_piece_encoder(tokenizer_json, pattern, lower), lower, added=added_tokens(tokenizer_json))


_SHARED: dict[tuple, PieceEncoder] = {}


def shared_encoder(kind: str, blob: bytes, make: Callable[[], PieceEncoder]) -> PieceEncoder:
    """One encoder a Python worker process, so that later tasks of the worker find its table filled.

    The key is a digest of the whole vocabulary. Tasks that do not ask for a table let go of it (``release``)."""
    key = (kind, hashlib.sha256(blob).digest())
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = make()
    return _SHARED[key]


def release() -> None:
    """Give up the table that earlier tasks of this worker left."""
    if _SHARED:
        _SHARED.clear()
        gc.collect()
