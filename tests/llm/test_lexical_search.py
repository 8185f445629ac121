"""Operator 12 against scores of all documents."""

import math
import random
import re
from collections import Counter

import helpers
import numpy as np
import pytest

from citeflow.llm import lexical_search, queries

ITEMS = "item_id long, text string, score long, rank int"
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UPPER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def items():
    texts = [None, "", "...", "the an an X", "don't word WORD", helpers.prose(1, 40), helpers.prose(3, 200), "nowhere", "中文 αΣ"]
    return [*((i, t, 5, 1) for i, t in enumerate(texts)), (None, "x y z", None, None)]


def brute(docs, tests, k=20):
    counts = [Counter(terms(d[1])) for d in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text, *_ in tests:
        scored = []
        for (doc_id, *_), c, n in zip(docs, counts, sizes):
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def save(spark, folder, docs, tests):
    helpers.table(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(tests, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_query_equals_brute_force(spark, tmp_dir):
    found = queries.op12_lexical_search(spark, save(spark, tmp_dir, helpers.rows(), items()))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(helpers.rows(), items())


@pytest.mark.parametrize("docs,tests", [([], items()), (helpers.rows(), []), ([], [])])
def test_empty_tables(spark, tmp_dir, docs, tests):
    assert queries.op12_lexical_search(spark, save(spark, tmp_dir, docs, tests)).collect() == []


def many(n=400):
    r = random.Random(4)
    return [(i, " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(r.randint(0, 30))), "en", 0, "", 0, "", 0) for i in range(n)]


def test_ties_blocks_and_shards(spark, monkeypatch):
    """Few words and many equal scores: ties go by id; small blocks of items and small groups of documents change nothing."""
    docs = [*many(), *((1000 - i, "a b c", "en", 0, "", 0, "", 0) for i in range(100))]
    tests = [(i, " ".join(random.Random(i).choices("abcdefghijklmnop", k=6)), 0, 0) for i in range(12)] + [(50, "a b c c", 0, 0)]
    rows, asked = helpers.table(spark, docs).repartition(3), spark.createDataFrame(tests, ITEMS)
    want = brute(docs, tests)
    assert sorted(map(tuple, lexical_search.search(rows, asked).collect()), key=str) == want
    assert sorted(map(tuple, lexical_search.search(rows, asked, most_terms=9).collect()), key=str) == want


def test_reading_stops_early_and_is_whole():
    """One shard: the k best of all scores, with a part of the documents accessed."""
    r = np.random.default_rng(5)
    n_docs, n_terms = 4000, 50
    size = np.full(n_docs, 6)
    term = np.concatenate([np.sort(r.choice(n_terms, 6, replace=False)) for _ in range(n_docs)]).astype("<i4")
    tf = r.zipf(2.0, n_docs * 6).clip(1, 60).astype("<i4")
    n = tf.reshape(-1, 6).sum(1)
    group = {"ids": np.arange(n_docs).astype("<i8").tobytes(), "no_id": np.zeros(n_docs, "u1").tobytes(), "n": n.astype("<i8").tobytes(),
             "size": size.astype("<i4").tobytes(), "term": term.tobytes(), "tf": tf.tobytes()}
    shard = lexical_search.Shard([group], n_terms, n_docs, int(n.sum()))
    for trial in range(20):
        q = lexical_search.Query(0, r.choice(n_terms, 3, replace=False), r.integers(1, 900, 3))
        best = lexical_search.Best(5)
        accessed = shard.search(q, best)
        score = np.zeros(n_docs, np.int64)
        weight = dict(zip(q.terms.tolist(), q.weight.tolist()))
        for place, t in enumerate(term.tolist()):
            score[place // 6] += weight.get(t, 0) * shard.impact[place]
        by = np.lexsort((np.arange(n_docs), -score))[:5]
        assert best.doc.tolist() == by.tolist() and best.score.tolist() == score[by].tolist()
        assert accessed < 0.9 * (score > 0).sum()
        assert not shard.seen.any() and not shard.met.any() and (shard.slot == -1).all()
