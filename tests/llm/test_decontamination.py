"""Operator 11 against brute force over words, and its index against brute force over symbols."""

import hashlib
import random
import re

import helpers
import numpy as np
import pytest

from citeflow.llm import fm_index, queries
from citeflow.llm.fm_index import FMIndex, WaveletMatrix, merged, suffix_array

ITEMS = "item_id long, text string, spans string, doc_id long"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def items():
    long = helpers.prose(3, 4000).split()
    texts = [None, "", " .,;", helpers.prose(1, 40), " ".join(long[100:130]).upper(), "X y", "Word", helpers.prose(2, 300)[500:900],
             "never seen phrase of ten words that no document holds at all", helpers.prose(1, 40)]
    out = [(i, t, "s", 1) for i, t in enumerate(texts)]
    return [*out, (4, out[4][1], "s", 1), (None, helpers.prose(5, 9), None, None), (100, helpers.prose(5, 9), None, None)]


def brute(docs, tests, window=10):
    phrases = {}
    for item, text, *_ in tests:
        w = words(text)
        for i in range(max(min(1, len(w)), len(w) - window + 1)):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if (p := tuple(w[i : i + size])) in phrases:
                    hit.update(range(i, i + size))
                    found |= phrases[p] - {None}
        ids = sorted(map(str, found))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def save(spark, folder, docs, tests):
    helpers.table(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(tests, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return folder


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_query_equals_brute_force(spark, tmp_dir):
    folder = save(spark, tmp_dir, helpers.rows(), items())
    found = queries.op11_decontamination(spark, folder)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == brute(helpers.rows(), items())


@pytest.mark.parametrize("docs,tests", [([], items()), (helpers.rows(), []), ([], [])])
def test_empty_tables(spark, tmp_dir, docs, tests):
    found = queries.op11_decontamination(spark, save(spark, tmp_dir, docs, tests))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, tests)


def test_small_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs, tests = helpers.table(spark), spark.createDataFrame(items(), ITEMS)
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "spans", "items").collect()))
    whole = key(fm_index.find(docs, tests))
    assert key(fm_index.find(docs, tests, most_phrases=60)) == whole


def test_shards_are_cut_at_documents():
    pairs = [(" ".join(f"w{j}" for j in range(i, i + 3)), str(i)) for i in range(30)]
    phrases = fm_index.Phrases(pairs)
    r = random.Random(2)
    docs = [" ".join(f"w{r.randint(0, 12)}" if r.random() < 0.4 else f"w{j % 33}" for j in range(r.randint(0, 60))).encode() for _ in range(50)]
    one = fm_index.Shard(phrases)
    one.add(docs)
    whole = next(one.found())
    for d, text in enumerate(docs):
        alone = fm_index.Shard(phrases)
        alone.add([text])
        counts, spans, found = next(alone.found())
        assert counts[0] == whole[0][d] and found[0] == whole[2][d]
        assert [x.tolist() for x in spans[0]] == [x.tolist() for x in whole[1][d]]


def test_all_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = helpers.table(spark).withColumnRenamed("ids", "N_Hit").withColumnRenamed("fp", "spans").withColumnRenamed("h", "items")
    found = fm_index.find(docs, spark.createDataFrame(items(), ITEMS))
    assert found.columns == ["doc_id", "lang", "id", "n_chars", "n_words", "n_hit", "spans", "items"]
    assert found.count() == len(helpers.rows())


def test_removed_texts_hold_no_phrase(spark):
    docs, tests = helpers.table(spark), spark.createDataFrame(items(), ITEMS)
    cut = fm_index.remove(docs, tests)
    assert cut.columns == docs.columns
    before = {r[0]: r for r in fm_index.find(docs, tests).select("doc_id", "spans", "n_words", "n_hit").collect()}
    texts = {r[0]: r[1] for r in helpers.rows()}
    for row in cut.where("doc_id is not null").collect():
        _, spans, n_words, n_hit = before[row.doc_id]
        data, kept, at = (texts[row.doc_id] or "").encode(), b"", 0
        for s in spans:
            kept += data[at : s["begin"]]
            at = s["end"]
        assert row.text.encode() == kept + data[at:]
        assert sum(len(words(data[s["begin"] : s["end"]].decode())) for s in spans) == n_hit


def test_index_equals_brute_force_over_symbols():
    r = np.random.default_rng(0)
    for _ in range(60):
        most, n = int(r.integers(1, 9)), int(r.integers(1, 300))
        text = r.integers(0, most + 1, n).astype(np.int32)
        text[-1] = 0
        phrases = [r.integers(1, most + 1, int(r.integers(1, 6))) for _ in range(30)]
        rows, lengths = np.zeros((30, 5), np.int64), np.array([len(p) for p in phrases])
        for i, p in enumerate(phrases):
            rows[i, : len(p)] = p
        phrase, place = FMIndex(text, most).occurrences(rows, lengths)
        want = [(i, j) for i, p in enumerate(phrases) for j in range(n - len(p) + 1) if (text[j : j + len(p)] == p).all()]
        assert sorted(zip(phrase.tolist(), place.tolist())) == want


def test_suffix_array_and_ranks():
    r = np.random.default_rng(1)
    text = np.tile(r.integers(1, 4, 40), 6).astype(np.int32)
    text[39::40] = 0
    apart = np.cumsum(text == 0)
    symbol = [int(x) + 100 if x else int(a) for x, a in zip(text, apart)]
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: symbol[i:])
    matrix = WaveletMatrix(text, 3)
    at = np.arange(len(text))
    got, before = matrix.at(at)
    assert got.tolist() == text.tolist() and before.tolist() == [int((text[:i] == text[i]).sum()) for i in at]
    assert matrix.rank(np.full(len(at), 2), at).tolist() == [int((text[:i] == 2).sum()) for i in at]


def test_merged():
    begin, end = merged(np.array([5, 1, 3, 9]), np.array([7, 4, 5, 10]))
    assert (begin.tolist(), end.tolist()) == ([1, 9], [7, 10])
