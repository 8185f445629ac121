import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

import helpers
from citeflow.llm import prefix_forest, quality_model, quality_rules, secrets


def labelled(n=240):
    """Good prose, and junk with symbols or repetition."""
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        t = helpers.prose(1000 + i, 60)
        if not good:
            t = " ".join(w + "%%%" for w in t.split()) if i % 2 else " ".join([t.split()[0]] * 60)
        docs.append((i, t, "en", 1, "x", 1, "h", len(t)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_model_on_held_out_rows(spark):
    docs, labels = labelled()
    df = helpers.table(spark, docs + helpers.rows()[:1] + [(None, None, *[None] * 6)])
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(df, known)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect() if r.doc_id is not None}
    held = [x for x in labels if x[0] % 4 == 0 and x[0]]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y, _ in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_scorer_equals_the_average_of_all_vectors():
    model = quality_model.SubwordModel()
    model.w[:] = np.random.default_rng(1).normal(size=model.w.shape)
    per = model.bucket_scores()
    scorer = quality_model.Scorer(per, 0.3, 0.1, max_words=5)
    for t in [x[1] for x in helpers.rows()]:
        at, n = quality_model.bag(t)
        z = (per[at] * n).sum() / n.sum() if len(at) else 0.0
        assert math.isclose(scorer.score(t), 1 / (1 + math.exp(-(z + 0.4))), rel_tol=1e-4)


def test_quality_model_learns_from_every_label(spark, monkeypatch):
    """More than 1,500 of a class, in several parts: every document's own word has moved."""
    monkeypatch.setattr(quality_model, "PART_ROWS", 600)
    monkeypatch.setattr(quality_model, "FAN_IN", 2)
    words = [f"{'good' if i % 2 else 'bad'}{i * 7919 % 100003}" for i in range(3400)]
    docs = spark.createDataFrame([(i, f"{w} {'fine' if i % 2 else 'poor'} text") for i, w in enumerate(words)] + [(7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(words))], "doc_id long, quality int")
    model, first = quality_model.train(docs.repartition(5), labels), quality_model.SubwordModel()
    at = [quality_model.features(w)[0] for i, w in enumerate(words) if i != 7]
    assert (model.e[at] != first.e[at]).any(1).all()
    got = quality_model.score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in got]) > 0.99


def test_quality_model_adds_up_neighbouring_parts_in_a_task(spark, monkeypatch):
    """Eight parts give two sums an epoch, not eight; documents that repeat an id are one, those without a label none."""
    added = []
    monkeypatch.setattr(quality_model, "PART_ROWS", 50)
    monkeypatch.setattr(quality_model, "_added", lambda total, r, plain=quality_model._added: added.append(r["n"]) or plain(total, r))
    docs = spark.createDataFrame([(i % 600, "fine text" if i % 2 else "poor text") for i in range(900)] + [(None, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    model = quality_model.train(docs.repartition(3), labels)
    assert len(added) <= 3 * 2 and sum(added) == 3 * 400
    assert all((r.score >= 0.5) == (r.text == "fine text") for r in quality_model.score(docs.withColumn("t", F.col("text")).where("doc_id is not null"), model, "t").collect())


def test_words_hashed_together_have_their_features():
    words = ["a", "ab", "naïve", "日本語テキスト", "x" * 300, "😀é😀", "<again>", "Ünïcödé-😀", "plain", "\ud800z"]
    flat, ends = quality_model.features_of(words)
    assert [sorted(x.tolist()) for x in np.split(flat, ends[:-1])] == [sorted(quality_model.features(w)) for w in words]
    texts = [f"{w} {w} other\n{w} {w} other" for w in words[:-1]] + [None, "", " \n"]
    each = [quality_model.bag(t) for t in texts]
    for (at, n), (want, times) in zip(quality_model.Bagger(max_words=3).bags(texts), each):
        assert at.tolist() == want.tolist() and n.tolist() == times.tolist()
    assert each[0][1].sum() == 4 * len(quality_model.features("a")) + 2 * len(quality_model.features("other")) + 5 * len(quality_model.features("<again>"))


def test_quality_model_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.train(helpers.table(spark), none)
    assert {r.score for r in quality_model.score(helpers.table(spark), model).collect()} == {0.5}
    assert quality_model.score(helpers.empty(spark), model).count() == 0


def slow_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    data = helpers.rows()[:11] + helpers.rows()[12:] + [(50, "a b c d e f a b c d e a b c d e\nx\n x\nx", *[None] * 6), (51, "#a *b\n\n|c", *[None] * 6)]
    got = quality_rules.measure(helpers.table(spark, data)).collect()
    have = sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert have == sorted(((x[0], *slow_measures(x[1])) for x in data), key=str)


def test_cutoffs_hold_their_exact_bound(spark):
    """Every admitted cutoff passes the binomial test computed with exact integers; refused ones fail it."""
    r = random.Random(2)
    n = 1500
    values = [0] * (n - 4) + [r.randint(2, 160) for _ in range(4)]
    rules = {x: F.lit(0).cast("long").alias(f"r_{x}") for x in quality_rules.RULES if x != "symbols"}
    good = spark.createDataFrame([(0, v) for v in values], "stratum int, r_symbols long").select("stratum", "r_symbols", *rules.values())
    chosen = {(c.rule, c.stratum): c.cutoff for c in quality_rules.choose_cutoffs(good).collect()}
    tests = sum(len(c) for _, c in quality_rules.RULES.values()) * 4
    rate, limit = 0.05 / 5, 0.05 / tests

    def admitted(k):
        return sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) <= limit

    ok = [(sum(v > c for v in values), c) for c in quality_rules.RULES["symbols"][1]]
    ok = [x for x in ok if admitted(x[0])]
    assert chosen[("symbols", 0)] == min(c for _, c in ok)
    # a few planted outliers among the good do not switch the rule off
    outliers = [0] * (n - 6) + [90] * 6
    loud = spark.createDataFrame([(0, v) for v in outliers], "stratum int, r_symbols long").select("stratum", "r_symbols", *rules.values())
    least = {(c.rule, c.stratum): c.cutoff for c in quality_rules.choose_cutoffs(loud).collect()}[("symbols", 0)]
    assert least == (min(quality_rules.RULES["symbols"][1]) if admitted(6) else min(c for c in quality_rules.RULES["symbols"][1] if c >= 90))
    few = good.limit(100)
    assert quality_rules.choose_cutoffs(few).count() == 0


def test_judge_awkward_rows(spark):
    labels = spark.createDataFrame([(8, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality_rules.judge(helpers.table(spark), labels)
    assert got.count() == len(helpers.rows()) and got.where("kept is null or base_failed is null").count() == 0
    assert got.where("kept and base_failed").count() == 0
    assert quality_rules.judge(helpers.empty(spark), labels.limit(0)).count() == 0


BASE = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
                  r"[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def test_base_findings_equal_plain_patterns():
    r = random.Random(1)
    parts = ["password", "Token", "api_key", "SECRET", '"', "'", ":", "=", " ", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "aK", "deadbeef", "\n", "ſecret", "."]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want = [("assign", m.start(), m.end()) for m in BASE.finditer(t) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        got = [x[:3] for x in secrets.base_findings(t, secrets.split_runs(t)[0])]
        assert got == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def secret_docs():
    r = random.Random(3)
    out = []
    for i in range(150):
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        out.append((i, f'{helpers.prose(i, 20)} token = "{key}" {helpers.prose(i + 500, 20)} 10.20.{i}.44 www{i}.example.com', *[None] * 6))
    return out


def test_network_gradients_and_threshold(spark):
    df = helpers.table(spark, secret_docs())
    net = secrets.train(df, sample=120)
    rows = [secrets.in_context(f"see {v} there", 4, 4 + len(v)) for v in ("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "www12.example.com")]
    yes, no = net.scores(rows)
    assert yes >= net.threshold > no and net.threshold >= 0.5


def test_secrets_redacted(spark):
    docs = secret_docs() + helpers.rows()
    df = helpers.table(spark, docs)
    net = secrets.train(df, sample=120)
    out = secrets.redact(df, net)
    assert out.columns == df.columns and out.count() == len(docs)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert "[SECRET]" in texts[20] and not re.search("[0-9a-f]{16}", texts[20])
    scanned = secrets.scan(df, net)
    assert scanned.count() == len(docs) and scanned.where("findings is null").count() == 0
    assert secrets.train(helpers.empty(spark)) is None and secrets.scan(helpers.empty(spark), None).count() == 0


def test_long_candidates_are_scored_whole():
    net = secrets.CharNet()
    row = (b"x" * 30 + bytes(random.Random(1).choices(range(33, 127), k=3000)) + b"y" * 30, 30, 3030)
    assert math.isclose(net.logits([row])[0], net.logits([row], places=200)[0], rel_tol=1e-4)


def brute(vectors, k):
    out = []
    good = [(i, np.array(v, float)) for i, v in vectors if v and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = list({i: (i, v) for i, v in reversed(good)}.values())
    for i, v in good:
        if i % 20 == 0:
            found = sorted((-(w * v).sum(), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j) for n, (_, j) in enumerate(found)]
    return sorted(out)


def test_forest(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in r.normal(size=16)]) for i in range(300)]
    vectors += [(300 + i, vectors[40][1]) for i in range(50)]
    vectors += [(400, None), (420, []), (440, [0.0] * 16), (460, [1.0] * 15 + [float("nan")]), (480, [1.0] * 15 + [None]), (None, [1.0] * 16),
                (500, [1.0, 2.0]), (520, [2.0, 1.0]), vectors[3]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x.rank, x.id) for x in prefix_forest.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(vectors, 20)  # fewer rows than candidates: every row is one
    found = prefix_forest.search(df, F.col("vec_id") % 20 == 0, trees=40, candidates=400, shard_rows=100).collect()
    hits = {(x.query_id, x.id) for x in found} & {(a, c) for a, _, c in got}
    assert len(hits) >= 0.9 * len(got) and len(found) == len(got)
    assert prefix_forest.search(df.limit(0), F.lit(True)).count() == 0
