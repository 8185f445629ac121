import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import helpers
from citeflow.llm import bpe_codec, packing, pretokens, record_files
from citeflow.llm.common import scratch_path

RANKS = P.path("byte_bpe_50k.tiktoken")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path):
    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe_codec.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def noise(n, seed=0):
    r = random.Random(seed)
    alphabet = " \n\t  ab'stZé12.,!\x1c\x85　Σİſ中文<|endoftext|>ñßKﬁ½\U0001f600"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_exact(ranks):
    some = dict(list(ranks.items())[:5000])
    h = bpe_codec.PerfectHash(some)
    assert sorted(h.slot(k) for k in some) == list(range(len(some)))
    assert all(h.get(k) == v for k, v in some.items()) and h.get(b"\xff no such token") == -1


def test_codec_equals_library_on_noise(reference):
    with open(RANKS, "rb") as f:
        blob = f.read()
    codec, decoder = bpe_codec.ByteBPE(blob, P.PATTERN), bpe_codec.Decoder(blob)
    codec.pieces.max_pieces = 50  # the table starts anew many times
    for t in noise(1500) + [x[1] or "" for x in helpers.rows()]:
        ids = codec.encode(t).tolist()
        assert ids == reference(t) and decoder.decode(ids) == t.encode()


@pytest.mark.parametrize("path,pattern,lower", [(BYTES, P.PATTERN, False), (WORDS, pretokens.WORD_PATTERN, True)])
def test_piece_encoder_equals_library(path, pattern, lower):
    with open(path, "rb") as f:
        encoder = pretokens.library_encoder(f.read(), pattern, lower)
    own = library(path)
    for t in noise(1500, 1) + [x[1] or "" for x in helpers.rows()]:
        assert encoder.encode(t).tolist() == own(t)


@pytest.mark.parametrize("path,pattern,lower", [(BYTES, P.PATTERN, False), (WORDS, pretokens.WORD_PATTERN, True)])
def test_added_tokens_and_new_letters_equal_library(path, pattern, lower):
    """Added tokens anywhere in a text, also in pieces, and letters newer than Python's tables at its beginning."""
    with open(path, "rb") as f:
        encoder = pretokens.library_encoder(f.read(), pattern, lower)
    own, r = library(path), random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", " ", "  ", "\n", "a", "Word", "word.", "\u0558", "\u088f", "\ua7cb", "é", "İ"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert encoder.encode(t).tolist() == own(t), t
    for c in [*range(0x0500, 0x0600), *range(0x0860, 0x08A0), *range(0xA7C0, 0xA7F0), *range(0x1C80, 0x1C90)]:
        assert encoder.encode(chr(c) + "x").tolist() == own(chr(c) + "x")


def test_segments_give_the_same_ids(monkeypatch, reference):
    monkeypatch.setattr(pretokens, "SEGMENT", 50)
    assert ["".join((" " if not f else "") + s for f, s in pretokens.segments(helpers.prose(9, 200), 50))] == [helpers.prose(9, 200)]


def test_encode_and_decode_tables(spark, reference):
    docs = helpers.table(spark).drop("ids")
    out = bpe_codec.decode(bpe_codec.encode(docs, RANKS, P.PATTERN), RANKS)
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()), key=str)
    want = sorted(((x[0], np.array(reference(x[1] or ""), "<u4").tobytes(), (x[1] or "").encode()) for x in helpers.rows()), key=str)
    assert got == want and {"lang", "fp", "id"} <= set(out.columns)
    assert bpe_codec.encode(helpers.empty(spark).drop("ids"), RANKS, P.PATTERN).count() == 0


def brute_cost(at, penalty, window):
    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + window - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= window))
    return best


def test_monotone_queue_equals_brute_force():
    r = random.Random(5)
    for _ in range(200):
        at = np.cumsum([0] + [r.randint(1, 9) for _ in range(40)])
        penalty = np.array([0.0] + [r.choice([0, 3, 7]) for _ in range(40)])
        assert packing.best_cuts(at, penalty, 12)[0].tolist() == brute_cost(at.tolist(), penalty.tolist(), 12)


def test_cuts_leave_no_gap_over_a_window():
    at, penalty = packing.possible_cuts(1000, np.array([700]), np.array([10, 20]), 64, 16, 64)
    assert at[0] == 0 and np.diff(np.append(at, 1000)).max() <= 64
    assert dict(zip(at.tolist(), penalty.tolist()))[700] == 0


def test_tail_is_padded_or_powers_of_two():
    assert packing.tail_lengths(4000, 4096, 16) == [2048, 1024, 512, 256, 128, 32] or packing.tail_lengths(4000, 4096, 16) == [4000]
    for n in range(0, 4097, 37):
        parts = packing.tail_lengths(n, 4096, 16)
        assert sum(parts) == n and (len(parts) <= 1 or all(x & (x - 1) == 0 for x in parts))


@pytest.mark.parametrize("block", [packing.BLOCK, 5000])
def test_packing(spark, monkeypatch, block):
    monkeypatch.setattr(packing.Packer.__init__, "__defaults__", (16.0, 64.0, 16.0, block))
    own = library(WORDS)
    data = [x for x in helpers.rows() if x[0] is not None][:14] + [(100 + i, helpers.prose(50 + i, 1500), *[None] * 6) for i in range(12)]
    out = packing.pack(helpers.table(spark, data).coalesce(2), WORDS).collect()
    filled = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert filled[r.sequence_id] == r.offset and len(r.ids) == 4 * r.length
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096
    padding = sum(4096 - n for n in filled.values() if n & (n - 1))
    assert padding < 0.05 * sum(filled.values())
    for x in data:
        mine = sorted((r for r in out if r.doc_id == x[0]), key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in mine)
        assert np.frombuffer(ids, "<u4").tolist() == [*own(x[1]), 2] and {r.doc_tokens for r in mine} == {len(ids) // 4}
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()


def test_packing_awkward_rows(spark):
    out = packing.pack(helpers.table(spark), WORDS)
    assert out.groupBy("doc_id").agg(F.sum("length")).count() == 15
    nulls = out.where("doc_id is null").agg(F.sum("length").alias("n")).first().n
    assert nulls == 2 + len(library(WORDS)(helpers.prose(6, 30)))
    assert packing.pack(helpers.empty(spark), WORDS).count() == 0


def test_frames():
    data = record_files.frame(b"abc") + record_files.frame(b"")
    one, at = record_files.unframe(memoryview(data))
    assert one == b"abc" and record_files.unframe(memoryview(data), at) == (b"", len(data))
    for i in (0, 8, 12, 15):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            record_files.unframe(memoryview(bytes(broken)))


def test_record_files(spark):
    own, folder = library(BYTES), scratch_path(spark, "records")
    record_files.write_records(helpers.table(spark), folder, BYTES, P.PATTERN)
    got = record_files.read_records(spark, folder).orderBy("start").collect()
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(got) == len(helpers.rows())
    at, want = 0, Counter((x[0], zlib.crc32(np.array([*own(x[1]), 0], "<u4").tobytes())) for x in helpers.rows())
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n
        at += r.n
    assert Counter((r.id, zlib.crc32(bytes(r.ids))) for r in got) == want


def test_record_files_empty(spark):
    folder = scratch_path(spark, "records")
    record_files.write_records(helpers.empty(spark), folder, BYTES, P.PATTERN)
    assert record_files.read_records(spark, folder).count() == 0
