import random

import numpy as np

from citeflow.operators import cluster as K


def test_standard_scale_population(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = K.standard_scale(df, ["a", "b"]).collect()
    z = [r.a_z for r in out]
    assert np.allclose(z, (np.array([1, 2, 3]) - 2) / np.std([1, 2, 3]))
    assert [r.b_z for r in out] == [0.0, 0.0, 0.0]


def brute_silhouette_sq(x, lab):
    x = np.asarray(x)
    lab = np.asarray(lab)
    s = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def test_silhouette_sq_matches_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, [rnd.gauss(c * 3, 1), rnd.gauss(0, 1)], c) for i, c in enumerate([0, 0, 1, 1, 2] * 8)]
    pts.append((999, [50.0, 50.0], 7))  # singleton cluster scores 0
    df = spark.createDataFrame(pts, "id int, x array<double>, cluster int")
    got = K.silhouette_sq(df).first()[0]
    assert abs(got - brute_silhouette_sq([p[1] for p in pts], [p[2] for p in pts])) < 1e-9


def test_two_tight_pairs(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [0.0, 0.1], 0), (2, [9.0, 9.0], 1), (3, [9.0, 9.1], 1)],
                               "id int, x array<double>, cluster int")
    assert K.silhouette_sq(df).first()[0] > 0.99


def test_kmedoids_update_is_exact(spark):
    rnd = random.Random(5)
    pts = [(i, [rnd.random(), rnd.random()]) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, x array<double>")
    meds, lab = K.kmedoids(df, 3, seed=1)
    rows = lab.collect()
    X = {r.id: np.array(r.x) for r in rows}
    for c, m in enumerate(meds):
        members = [r.id for r in rows if r.cluster == c]
        cost = {i: sum(((X[i] - X[j]) ** 2).sum() for j in members) for i in members}
        assert cost[m] <= min(cost.values()) + 1e-9


def test_assign_and_inertia(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], "id int, x array<double>")
    out = {r.id: r.cluster for r in K.assign_nearest(df, [[9.0, 0.0], [1.0, 0.0]], ids=[5, 6]).collect()}
    assert out == {0: 6, 1: 5}
    df2 = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert K.inertia_k1(df2, ["a", "b"]) == 2.0


def test_membership_flatten(spark):
    df = spark.createDataFrame([(0, [4, 2]), (1, [7])], "c int, m array<int>")
    got = sorted(tuple(r) for r in K.cluster_membership_flatten(df, "c", "m").collect())
    assert got == [(2, 0, 1), (4, 0, 0), (7, 1, 0)]


def test_silhouette_equals_all_pairs(spark):
    import math
    import random
    r = random.Random(3)
    pts = [(r.randint(0, 6), r.randint(0, 5), r.randint(0, 3)) for _ in range(150)] + [(40, 40, 9), (0, 0, None)]
    df = spark.createDataFrame([([float(a), float(b)], c) for a, b, c in pts], "x array<double>, cluster int").repartition(3)
    rows = [p for p in pts if p[2] is not None]
    total = 0.0
    for i, p in enumerate(rows):
        far = {}
        for j, q in enumerate(rows):
            if i != j:
                far.setdefault(q[2], []).append(math.dist(p[:2], q[:2]))
        if p[2] in far:
            a, b = (sum(far[p[2]]) / len(far[p[2]]), min(sum(v) / len(v) for c, v in far.items() if c != p[2]))
            total += (b - a) / max(a, b) if max(a, b) else 0.0
    for block in (7, 8192):
        got = K.silhouette(df, block_points=block).first()[0]
        assert abs(got - total / len(rows)) < 1e-12
    assert K.silhouette(df.where("cluster = 1")).first()[0] is None


def test_silhouette_two_tight_pairs(spark):
    df = spark.createDataFrame([([0.0], 0), ([0.0], 0), ([9.0], 1), ([9.0], 1), ([50.0], 2)], "x array<double>, cluster int")
    assert abs(K.silhouette(df).first()[0] - 4 / 5) < 1e-12


def test_kmeans_from_farthest_first_centres(spark):
    r = np.random.default_rng(4)
    pts = np.round(np.concatenate([r.normal(c, 1.0, (60, 2)) for c in ((0, 0), (8, 0), (0, 9), (9, 9))]), 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double").repartition(3)
    first = K.farthest_first(df, ["a", "b"], 4, "id")
    assert K.farthest_first(df, ["a", "b"], 2, "id") == first[:2]
    lab = {r.id: r.cluster for r in K.kmeans_from(df, ["a", "b"], 4, "id").collect()}
    centres = np.array(first)
    for _ in range(100):
        own = ((pts[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([pts[own == j].mean(0) for j in range(4)])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    assert [lab[i] for i in range(len(pts))] == own.tolist()
    curve = {r.k: r.inertia for r in K.elbow(df, ["a", "b"], range(1, 7), "id").collect()}
    alone = K.lloyd(df, ["a", "b"], {4: first})[4][1]
    assert abs(curve[4] - alone) < 1e-9 and abs(curve[1] - ((pts - pts.mean(0)) ** 2).sum()) < 1e-6
    assert all(curve[k] > curve[k + 1] for k in range(1, 4))
    assert K.farthest_first(df.limit(0), ["a", "b"], 3, "id") == []
