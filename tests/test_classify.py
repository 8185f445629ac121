import random

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array

from citeflow.operators import classify as C


def test_one_hot_unseen_and_null(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    m = Pipeline(stages=C.one_hot_stages(["c"])).fit(C.prepare_categoricals(train, ["c"]))
    test = spark.createDataFrame([("a",), ("zzz",), (None,)], "c string")
    vecs = [list(r[0]) for r in m.transform(C.prepare_categoricals(test, ["c"])).select(vector_to_array("c__oh")).collect()]
    assert sum(vecs[0]) == 1 and sum(vecs[1]) == 0 and sum(vecs[2]) == 1 and vecs[0] != vecs[2]


def test_report_never_predicted(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    rep = {r["class"]: r for r in C.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].support == 2
    assert abs(rep["accuracy"].f1 - 1 / 3) < 1e-12


def test_auc_with_ties_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(2), float(rnd.randrange(10)) / 10) for _ in range(300)]
    got = C.roc_auc(spark.createDataFrame(rows, "label int, p double")).first()[0]
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    ref = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got - ref) < 1e-12


def test_auc_of_one_class_is_null(spark):
    assert C.roc_auc(spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, p double")).first()[0] is None


def test_features_are_scaled_by_the_population_deviation(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "b"), (5.0, "a")], "v double, c string")
    data = C.prepare_categoricals(df, ["c"])
    got = Pipeline(stages=C.feature_pipeline(["v"], ["c"], rows=3)).fit(data).transform(data)
    z = [r[0][0] for r in got.select(vector_to_array("features")).collect()]
    sd = (sum((x - 2.0) ** 2 for x in (0.0, 1.0, 5.0)) / 3) ** 0.5
    assert all(abs(a - (x - 2.0) / sd) < 1e-9 for a, x in zip(z, (0.0, 1.0, 5.0)))


def test_split_is_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    tr, te = C.train_test_split(df, "k")
    assert tr.count() + te.count() == 1000 and 120 < te.count() < 280
    tr2, _ = C.train_test_split(df.repartition(7), "k")
    assert sorted(r.k for r in tr.collect()) == sorted(r.k for r in tr2.collect())


def test_validation_curve_monotone_objective(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        y = rnd.randrange(2)
        rows.append((i, float(rnd.gauss(2.0 * y, 1.0)), float(rnd.gauss(0, 1)), "ab"[rnd.randrange(2)], y))
    df = spark.createDataFrame(rows, "work_id long, a double, b double, cat string, label int")
    curve = C.validation_curve(df, ["a", "b"], ["cat"], steps=(2, 6, 12)).orderBy("iterations").collect()
    objs = [r.train_objective for r in curve]
    assert [r.iterations for r in curve] == [2, 6, 12]
    assert all(b <= a + 1e-9 for a, b in zip(objs, objs[1:]))
    assert all(0 <= r.val_mae <= 1 and r.val_logloss > 0 for r in curve)


def test_category_slots_are_dense_ranks(spark):
    rows = [(v,) for v in ["b", "a", None, "é", "b", "", "Z", "a"] * 3 + [f"t{i:03d}" for i in range(200)]]
    df = spark.createDataFrame(rows, "v string")
    want = {v: i for i, v in enumerate(sorted({C.NULL_CATEGORY if v is None else v for v, in rows}, key=lambda s: s.encode()))}
    for parts in (1, 7):
        slots, n = C.category_slots(df.repartition(parts), "v")
        assert {r.value: r.slot for r in slots.collect()} == want and n == len(want)
    none, n = C.category_slots(df.limit(0), "v")
    assert none.count() == 0 and n == 0


def test_sparse_features(spark):
    fit = spark.createDataFrame([(1, 2.0, "x", "p"), (2, 4.0, "y", None)], "id long, v double, a string, b string")
    rows = spark.createDataFrame([(3, 3.0, "y", "p"), (4, 5.0, "new", None)], "id long, v double, a string, b string")
    out, size = C.sparse_features(fit, rows, ["v"], ["a", "b"])
    got = {r.id: (r.indices, r["values"]) for r in out.collect()}
    # slots: 0 the number, 1-2 x and y, 3 null (its name begins with the least character), 4 p
    assert size == 5 and got == {3: ([0, 2, 4], [0.0, 1.0, 1.0]), 4: ([0, 3], [2.0, 1.0])}
    assert out.columns == ["id", "v", "a", "b", "indices", "values"]


def test_tasks_of_training_vectors_follow_their_bytes(spark, monkeypatch):
    rows = [(i, float(i % 2), float(i), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "work_id long, label double, x double, c string")
    few = C._prepared(df, ["x"], ["c"], (), "label", 16)
    monkeypatch.setattr(C, "TASK_BYTES", 300 * few[2] * 8 // 10)
    many = C._prepared(df, ["x"], ["c"], (), "label", 16)
    assert many[1].rdd.getNumPartitions() == 10 and many[2] == few[2]
    key = lambda r: (r.label, r.features.toArray().tolist())
    assert sorted(map(key, many[1].collect())) == sorted(map(key, few[1].collect()))


def sparse_rows(spark, n=300):
    rnd, rows = random.Random(4), []
    for i in range(n):
        y = rnd.randrange(2)
        rows.append((i, float(rnd.gauss(2.0 * y, 1.0)), float(rnd.gauss(0, 1)), "ab"[rnd.randrange(2)], f"t{i % 40}", y))
    return spark.createDataFrame(rows, "work_id long, a double, b double, cat string, t string, label int")


def test_sparse_training_equals_spark_ml(spark):
    """The same history and weights as Spark ML's own fit, also with partitions whose last stack is short."""
    _, vectors, n = C._prepared(sparse_rows(spark).coalesce(1), ["a", "b"], ["cat"], ["t"], "label", 16)
    estimator = C.mlp_classifier(n, hidden=(5, 3), max_iter=12).setBlockSize(70)
    for given in (vectors, vectors.repartition(3)):
        theirs = estimator.fit(given)
        summary = theirs.summary() if callable(theirs.summary) else theirs.summary
        ours = list(C.perceptron.train(given, estimator))
        assert len(ours) == len(summary.objectiveHistory) == 13
        assert all(abs(a - b) < 1e-8 for a, (_, b) in zip(summary.objectiveHistory, ours))
        assert abs(theirs.weights.toArray() - ours[-1][0]).max() < 1e-5
    assert (C.perceptron.model_of(spark, estimator, ours[-1][0]).weights.toArray() == ours[-1][0]).all()


def test_first_layer_of_sparse_blocks():
    import numpy as np
    r = np.random.default_rng(1)
    dense = r.normal(size=(40, 30)) * (r.random((40, 30)) < np.linspace(0, 0.5, 30))
    row, at = np.nonzero(dense)
    times, back = C.perceptron.first_layer(np.bincount(row, minlength=40), at, dense[row, at], 30)
    w, d = r.normal(size=(30, 7)), r.normal(size=(40, 7))
    assert np.allclose(times(w), dense @ w) and np.allclose(back(d), dense.T @ d)


def test_validation_curve_is_one_run(spark, monkeypatch):
    """Every row of the curve is the fit of that many iterations; the network is trained once."""
    df, calls, train = sparse_rows(spark), [], C.perceptron.train
    monkeypatch.setattr(C.perceptron, "train", lambda *a: calls.append(a) or train(*a))
    curve = {r.iterations: r.train_objective for r in C.validation_curve(df, ["a", "b"], ["cat"], ["t"], steps=(1, 3)).collect()}
    assert len(calls) == 1
    fit, _ = C.train_test_split(df, "work_id", 20, salt="/validation")
    for n, objective in curve.items():
        assert abs(C.fit_classifier(fit, ["a", "b"], ["cat"], ["t"], max_iter=n).objectives[-1] - objective) < 1e-9
