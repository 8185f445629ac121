"""Operator 7: token counts of sections by offset-mapped attribution.

Every whole document is encoded once. The tokens' lengths give their spans in the text, and each token is joined to a
section by its span (a binary search over the sections' begins), so counts of sections add up to the document's count,
which separate encodings of the sections would not give.

Rule for tokens that cross a boundary: a token belongs to the section that holds its first character that is not white
space (a word's leading space goes with the word); a token of white space only belongs to the section of its first
character. A token that splits a character belongs where that character is.

Sections are lines (a line's break belongs to it), or given as ascending code-point positions where each begins; text
before the first one is section -1.

Scale: one pass without a shuffle; a task holds one step of texts. Cases: a null or empty text has one section without
tokens; very long texts are encoded in segments; repeated rows give repeated results; an empty table gives an empty table;
only the id, the text and the sections are looked at, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.bpe_codec import vocabulary
from citeflow.llm.common import map_arrow, slices
from citeflow.llm.pretokens import byte_to_char, library_encoder, shared_encoder

SPACE = b" \t\n\x0b\x0c\r"


def token_shapes(tokenizer_json: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token, and its leading white space (0 if it has nothing else)."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(tokenizer_json.decode()).get_vocab()
    size, lead = np.zeros(max(vocab.values()) + 1, np.int64), np.zeros(max(vocab.values()) + 1, np.int64)
    back = {c: b for b, c in byte_to_char().items()}
    for token, i in vocab.items():
        data = bytes(back.get(c, 0x61) for c in token)
        rest = data.lstrip(SPACE)
        size[i], lead[i] = len(data), len(data) - len(rest) if rest else 0
    return size, lead


def attribute(ids: np.ndarray, data: np.ndarray, begins: np.ndarray, size: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross its boundary; ``begins`` are ascending byte places, 0 first."""
    ends = np.cumsum(size[ids])
    start = ends - size[ids]
    at = start + lead[ids]
    inside = (data[at] & 0xC0) == 0x80  # in the middle of a character: go back to where it begins
    while inside.any():
        at = at - inside
        inside = (data[at] & 0xC0) == 0x80
    section = np.searchsorted(begins, at, "right") - 1
    crosses = np.searchsorted(begins, start, "right") != np.searchsorted(begins, ends - 1, "right")
    return np.bincount(section, minlength=len(begins)), np.bincount(section[crosses], minlength=len(begins))


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 begins_col: str | None = None) -> DataFrame:
    """One row a section: id, section (from 0), start and end (code points, end exclusive), n_tokens, n_crossing."""
    blob = vocabulary(docs.sparkSession, path)
    begins = F.col(begins_col).cast("array<long>") if begins_col else F.lit(None).cast("array<long>")
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), begins.alias("begins"))
    schema = T.StructType([df.schema["id"], *(T.StructField(n, T.LongType()) for n in ("section", "start", "end", "n_tokens", "n_crossing"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder("bytes" + pattern, blob.value, lambda: library_encoder(blob.value, pattern, False))
        size, lead = token_shapes(blob.value)
        for batch in batches:
            for part in slices(batch, 1):
                who, cols = [], []
                for i, (text, given) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    data = np.frombuffer(text.encode(), np.uint8)
                    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte place of each code point
                    if given is None:
                        cut = np.searchsorted(chars, np.flatnonzero(data == 10) + 1)
                    else:
                        cut = np.array([g for g in given if g is not None], np.int64)
                    known = given is None or 0 in given
                    cut = np.union1d([0], cut[cut < len(chars) - 1]).astype(np.int64)
                    ids = encoder.encode(text)
                    n, crossing = attribute(ids, data, chars[cut], size, lead) if len(ids) else (np.zeros(len(cut), np.int64),) * 2
                    cols.append((np.arange(len(cut)) - (not known), cut, np.append(cut[1:], len(chars) - 1), n, crossing))
                    who.append(np.full(len(cut), i))
                ids_out = part.column(0).take(pa.array(np.concatenate(who)))
                yield pa.RecordBatch.from_arrays([ids_out, *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*cols))], names=schema.names)

    out = map_arrow(df, run, schema, keeps_table=True)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
