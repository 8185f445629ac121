import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import helpers
from citeflow.llm import repeats, simhash
from citeflow.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 7)
    for t in [x[1] for x in helpers.rows()] + ["A b\x1cC d e", "É é a\x85b c d"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def near(seed, n, flips):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n)]
    out = [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, flips))) for b in base for _ in range(4)]
    return np.unique(np.array(out, np.uint64))


def test_tiles_find_all_links():
    fps = near(1, 150, 4)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    at = {int(f.astype("<i8")): i for i, f in enumerate(fps)}
    got = roots(len(fps), [(at[a], at[b]) for a, b in simhash.link_tiles(fps, None, 4, most=50)])
    assert got == want
    a, b = fps[::2], fps[1::2]
    links = simhash.link_tiles(a, None, 4) + simhash.link_tiles(b, None, 4) + simhash.link_tiles(a, b, 4)
    assert roots(len(fps), [(at[x], at[y]) for x, y in links]) == want


def test_plan_pairs_every_close_cell():
    r = random.Random(3)
    cells = {tuple(r.randint(4, 12) for _ in range(4)): r.randint(1, 30) for _ in range(80)}
    placed, pairs = simhash.plan_tiles([(*c, n) for c, n in cells.items()], 25, 4)
    tiles = {}
    for p, t, side in pairs:
        tiles.setdefault(p, []).append(t)
    met = {tuple(sorted((t[0], t[-1]))) for t in tiles.values()}
    of = {c[:4]: range(c[4], c[4] + c[5]) for c in placed}
    for x in cells:
        for y in cells:
            if sum(abs(a - b) for a, b in zip(x, y)) <= 4:
                assert all(tuple(sorted((t, u))) in met for t in of[x] for u in of[y])


def test_link_fingerprints_over_many_tiles(spark):
    fps = near(2, 120, 4)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = simhash.link_fingerprints(df, 4, tile=40).collect()
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    assert roots(len(fps), [(at[r.u], at[r.v]) for r in links]) == want


def test_near_duplicates(spark):
    r = random.Random(8)
    words = [helpers.prose(20, 400).split() for _ in range(1)][0]
    copies = [(1000 + i, " ".join(w if r.random() > 0.01 else "changed" for w in words), *[None] * 6) for i in range(25)]
    data = helpers.rows() + copies
    got = simhash.near_duplicates(helpers.table(spark, data)).collect()
    assert len(got) == len(data)
    fps = [slow_fingerprint(x[1]) for x in data]
    of = roots(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for x, root in zip(data, of):
        least[root] = min((v for v in (least.get(root), x[0]) if v is not None), default=None)
    want = sorted(((x[0], f, least[root]) for x, f, root in zip(data, fps, of)), key=str)
    assert sorted(((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in got), key=str) == want
    kept = simhash.keep_one(helpers.table(spark, data))
    assert kept.columns == helpers.table(spark).columns and kept.count() == len(set(of))
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0 and simhash.keep_one(helpers.empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, x) for x in range(501, 540)] + [(7, 7), (3, 2)]
    got = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(61)} | {(x, 500) for x in range(500, 540)} and len(got) == 101


def slow_spans(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def passages():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, line = text(180), text(70)
    out = [text(r.randint(0, 400)) + shared[r.randint(0, 60) : r.randint(120, 180)] + text(r.randint(0, 300)) for _ in range(60)]
    out += [line * 6, line + text(100) + line, "z" * 500, "z" * 130, "ab" * 200, out[0], out[1][5:], None, "", text(30)]
    return out


def check_repeats(spark, texts, length, most):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, key string, n long")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length, most).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (removed, spans, kept) in enumerate(slow_spans(data, length)):
        r = got[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) == (len(data[i]), removed, spans, kept)


def test_repeats_equal_brute_force(spark):
    check_repeats(spark, passages(), 60, 1024)


def test_repeats_with_large_buckets_and_small_buffers(spark, monkeypatch):
    check_repeats(spark, passages(), 50, 2)


@pytest.mark.parametrize("most", [1024, 1])
def test_structured_texts_are_not_taken_for_repeats(spark, most):
    """A Thue-Morse string and its complement have equal polynomial hashes modulo 2^64, whatever the base."""
    r = random.Random(2)
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    tails = ["".join(r.choice("cdefgh ") for _ in range(400)) for _ in range(4)]
    check_repeats(spark, [x + t for t in tails for x in (morse, morse.translate({97: 98, 98: 97}))] + [morse + tails[0]], 1200, most)


def test_chunks_of_long_texts_overlap(monkeypatch):
    monkeypatch.setattr(repeats, "LONG", 300)
    monkeypatch.setattr(repeats, "STEP", 500)
    texts = [t.encode() for t in passages() if t] + [b"q" * 1000]
    places = {}
    for at, data, begins in repeats.chunks(texts, 60):
        text, first, n, off, key, whole = repeats.segments(data, begins, 60)
        for t, f, k in zip(text, first, n):
            i, o = at[t]
            for s in range(f + o, f + o + k + 1):
                places[i, s] = places.get((i, s), 0) + 1
    assert places == {(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - 59)}


def test_suffix_order_and_collisions(monkeypatch):
    r = random.Random(6)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(400)).encode(), np.uint8)
    at = np.arange(300)
    group = np.repeat(np.arange(3), 100)
    order = repeats.SuffixSorter(data, 30).sort(group, at)
    text = data.tobytes()
    for g in range(3):
        inside = at[order[group == g]]
        assert [text[i : i + 30] for i in inside] == sorted(text[i : i + 30] for i in at[group == g])
    want = repeats.SuffixSorter(data, 9).repeated(group, at)
    weak = repeats.Poly(1)  # sums of bytes: collides all the time
    monkeypatch.setattr(repeats, "POLY_A", weak)
    assert repeats.SuffixSorter(data, 9).repeated(group, at).tolist() == want.tolist()


def test_repeats_awkward_rows(spark):
    docs = helpers.table(spark)
    out = repeats.remove_repeats(docs, 200)
    assert out.count() == len(helpers.rows()) and out.where("kept is null").count() == 0
    assert all(len(r.kept) == 0 for r in out.where("doc_id in (8, 9)").collect())
    text = repeats.remove_repeats(docs, 200, as_text=True)
    assert dict(text.dtypes)["kept"] == "string"
    assert repeats.remove_repeats(helpers.empty(spark), 200).count() == 0


def test_segment_buffers_are_small():
    """What a worker holds while it finds segments is some fifteen numbers a byte of a buffer."""
    texts = [b"x" * 3000] * 2000 + [b"y" * (1 << 20)] + [b"z" * 3000] * 300
    got = list(repeats.chunks(texts, 200))
    assert max(len(data) for places, data, _ in got if len(places) > 1) <= 1 << 19
    assert sum(len(data) for _, data, _ in got) == sum(map(len, texts))
    assert sorted(i for places, _, _ in got for i, _ in places) == list(range(len(texts)))
