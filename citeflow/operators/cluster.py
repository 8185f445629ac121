"""Clustering of authors: M1-M8.

Fitting steps end in a *bounded* collect (one row of means, k centres of d
values, per-cluster sums), like Spark ML's own estimators; every per-row step
is a JVM expression with the fitted values as literals, so assignment needs
no join and no pair of rows is ever formed.

Exactness without pairs: under squared Euclidean distance,
sum_y |m - y|^2 = n |m - mu|^2 + const, so the k-medoids update (the member
with the least total distance to its cluster) is the member closest to the
centroid; and the silhouette's mean distance to a cluster is
(n |x|^2 - 2 x.S + Q) / n from the cluster's count, sum S and sum of squares Q.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.session import cut_lineage, map_in_arrow


#: Decimals to which k-medoids compares distances.
TIE_DIGITS = 9

# -- M1 ----------------------------------------------------------------------------------


def standard_scale_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Means and *population* standard deviations (one aggregate row)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_z",
                   stats: dict | None = None) -> DataFrame:
    """z-score with the population std; a constant column scales to 0."""
    stats = stats or standard_scale_fit(df, cols)
    out = df
    for c in cols:
        m, s = stats[c]
        z = (F.col(c) - F.lit(m)) / F.lit(s) if s and s > 0 else F.lit(0.0)
        out = out.withColumn(c + suffix, z.cast("double"))
    return out


# -- vectors as arrays ------------------------------------------------------------------------


def as_array(df: DataFrame, cols: Sequence[str] | str, name: str = "x") -> DataFrame:
    """Feature columns (or one array column) -> one array<double> column."""
    if isinstance(cols, str):
        return df.withColumn(name, F.transform(F.col(cols), lambda v: v.cast("double")))
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))


def _sqdist(x: Column, centre: Sequence[float]) -> Column:
    c = F.array(*[F.lit(float(v)) for v in centre])
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)


def assign_nearest(df: DataFrame, centres: Sequence[Sequence[float]], x: str = "x",
                   label: str = "cluster", dist: str = "sqdist", ids: Sequence | None = None, digits: int | None = None) -> DataFrame:
    """M4: nearest centre per row (ties: smallest centre id). The k centres
    are literals of the expression — bounded by k x d, no join. With ``digits`` distances are compared rounded, so that points
    midway between centres are ties whatever the last bits say."""
    shown = (lambda v: F.round(v, digits)) if digits is not None else (lambda v: v)
    ids = list(ids) if ids is not None else list(range(len(centres)))
    cands = F.array(*[F.struct(shown(_sqdist(F.col(x), c)).alias("d"), F.lit(i).alias("i"))
                      for i, c in zip(ids, centres)])
    best = F.array_min(cands)
    return df.withColumn(label, best.getField("i")).withColumn(dist, best.getField("d"))


def cluster_sums(df: DataFrame, x: str = "x", label: str = "cluster") -> list[dict]:
    """Per cluster: n, vector sum, sum of squared norms (k rows collected)."""
    dim = df.select(F.size(x).alias("d")).where(F.col("d") > 0).first()
    dim = dim["d"] if dim else 0
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + v * v)).alias("q")]
    aggs += [F.sum(F.col(x)[j]).alias(f"s{j}") for j in range(dim)]
    rows = df.groupBy(label).agg(*aggs).collect()
    return sorted(({"label": r[label], "n": r["n"], "q": r["q"], "s": [r[f"s{j}"] for j in range(dim)]}
                   for r in rows), key=lambda t: t["label"])


def centres_from_labels(df: DataFrame, x: str = "x", label: str = "cluster") -> list[tuple]:
    """Mean vector per label, ordered by label."""
    return [(t["label"], [v / t["n"] for v in t["s"]]) for t in cluster_sums(df, x, label)]


# -- M5 ----------------------------------------------------------------------------------------


def silhouette_sq(df: DataFrame, x: str = "x", label: str = "cluster") -> DataFrame:
    """Mean silhouette with *squared* Euclidean distance, exact, O(n k).

    Per row: a = D(x, own)/(n_own - 1), b = min over other clusters of
    D(x, C)/n_C with D(x, C) = n_C |x|^2 - 2 x.S_C + Q_C; s = (b - a)/max(a, b);
    a singleton cluster scores 0. This is exactly Spark ML's
    ClusteringEvaluator (squaredEuclidean), which computes it JVM-side from
    the per-cluster sums, so that is what runs. (The Euclidean, non-squared
    silhouette has no such decomposition; named differently on purpose.)
    """
    spark = df.sparkSession
    if df.select(label).distinct().limit(2).count() < 2:
        return spark.createDataFrame([(None,)], "silhouette_sq double")
    ev = ClusteringEvaluator(featuresCol="_v", predictionCol="_lab", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    value = ev.evaluate(df.select(array_to_vector(F.col(x)).alias("_v"), F.col(label).cast("double").alias("_lab")))
    return spark.createDataFrame([(float(value),)], "silhouette_sq double")


def silhouette(df: DataFrame, x: str = "x", label: str = "cluster", block_points: int = 8192) -> DataFrame:
    """M5: mean silhouette with the Euclidean distance, exact.

    Distances between all points are inherent, so the work is O(m^2 d) in the number m of *distinct* (point, label) pairs, which
    an aggregate finds first (authors share few counts). No pair of points is a row: the points are taken in blocks of
    about ``block_points`` (dealt by hash, broadcast, bounded), and a pass adds to each point's sums of distances, one
    a cluster, the block's part, by numpy in Arrow batches. Passes follow one another in the same task; nothing is shuffled
    but the distinct points. A singleton cluster scores 0; fewer than two clusters give null; rows without label or point are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & F.col(x).isNotNull()).select(
        F.transform(F.col(x), lambda v: v.cast("double") + F.lit(0.0)).alias("x"), F.col(label).alias("label"))
    points = cut_lineage(rows.groupBy("x", "label").agg(F.count("*").alias("n")), "silhouette-points")
    sizes = {r.label: r.n for r in points.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a cluster
    if len(sizes) < 2:
        return spark.createDataFrame([(None,)], "silhouette double")
    order = {c: i for i, c in enumerate(sorted(sizes))}
    blocks = max(1, -(-points.count() // block_points))
    dealt = points.withColumn("block", F.pmod(F.xxhash64("x", "label"), F.lit(blocks)))
    now = points.select("x", "label", "n", F.array(*[F.lit(0.0)] * len(order)).alias("sums"))
    for b in range(blocks):
        part = dealt.where(F.col("block") == b).select("x", "label", "n").collect()
        if part:
            weight = np.zeros((len(part), len(order)))
            weight[np.arange(len(part)), [order[r.label] for r in part]] = [r.n for r in part]
            now = _add_distances(now, spark.sparkContext.broadcast((np.array([r.x for r in part]), weight)))
        if b % 16 == 15:
            now = cut_lineage(now, "silhouette-sums")
    at = {c: F.col("sums")[i] for c, i in order.items()}
    own, size = (F.coalesce(*[F.when(F.col("label") == F.lit(c), v) for c, v in vs.items()]) for vs in (at, {c: F.lit(n) for c, n in sizes.items()}))
    a = own / (size - 1)
    b = F.array_min(F.array(*[F.when(F.col("label") != F.lit(c), at[c] / sizes[c]) for c in order]))
    score = F.when(size == 1, 0.0).when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)
    return now.agg((F.sum(score * F.col("n")) / F.sum("n")).alias("silhouette"))


def _add_distances(points: DataFrame, block) -> DataFrame:
    """``points`` (x, label, n, sums) with the block's weighted distances added to sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, weight = block.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                here = np.array(part.column(0).to_pylist())
                square = np.zeros((len(here), len(there)))
                for j in range(here.shape[1]):  # differences, not products: equal points are at distance 0 exactly
                    square += (here[:, j, None] - there[None, :, j]) ** 2
                sums = np.array(part.column(3).to_pylist()) + np.sqrt(square) @ weight
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sums.tolist(), pa.list_(pa.float64()))], names=part.schema.names)

    return map_in_arrow(points, run, points.schema)


# -- M2 / M3 -----------------------------------------------------------------------------------------


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42, max_iter: int = 1000,
           label: str = "cluster"):
    """M2: Spark ML k-means (k-means|| init, seeded). Returns (model, labelled); raises if it has not converged after
    ``max_iter`` steps."""
    va = VectorAssembler(inputCols=list(cols), outputCol="_features")
    feats = va.transform(df)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol=label).fit(feats)
    if model.summary.numIter >= max_iter:
        raise RuntimeError(f"k-means has not converged after {max_iter} steps")
    return model, model.transform(feats).drop("_features")


def _literal(centres: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])


def _nearest(x: Column, centres: Sequence[Sequence[float]]) -> Column:
    """struct(d, i) of the nearest centre (ties: the first). The centres are one literal, so steps share their compiled code."""
    apart = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.array_min(F.transform(_literal(centres), lambda c, i: F.struct(apart(c).alias("d"), i.alias("i"))))


def farthest_first(df: DataFrame, cols: Sequence[str], k: int, id_col: str, seed: int = 42) -> list[list[float]]:
    """k seeded first centres: the row with the least md5(id || seed), then each time the row farthest from all centres so far
    (ties by id). Every pick is a top-1 over all rows; a smaller k has a prefix of the picks."""
    name = F.col(id_col).cast("string")
    rows = as_array(df, cols, "__x").select("__x", name.alias("__id"))
    first = rows.orderBy(F.md5(F.concat("__id", F.lit(str(seed)))), "__id").first()
    out = [list(first["__x"])] if first else []
    while out and len(out) < k:
        far = F.round(_nearest(F.col("__x"), out)["d"], 9)
        out.append(list(rows.orderBy(far.desc(), "__id").first()["__x"]))
    return out


def lloyd(df: DataFrame, cols: Sequence[str], starts: dict[int, Sequence[Sequence[float]]], digits: int = 9) -> dict[int, tuple[list[list[float]], float]]:
    """M2, M3: k-means steps from given first centres, for all ``starts`` (name -> centres) at once -> name -> (centres, inertia).

    Rows are first counted by distinct point. A step is one aggregate that assigns every point under every open name and
    sums all clusters (as many rows to the driver as there are centres). A name is done when its centres, rounded, stay; an
    empty cluster keeps its centre. Inertia falls with every step, so the steps end.
    """
    points = cut_lineage(as_array(df, cols, "x").groupBy("x").agg(F.count("*").alias("n")), "points")
    now = {name: [list(c) for c in centres] for name, centres in starts.items()}
    done: dict[int, tuple[list[list[float]], float]] = {}
    while now:
        each = F.array(*[F.struct(F.lit(name).alias("name"), _nearest(F.col("x"), centres).alias("a")) for name, centres in now.items()])
        rows = (points.select("x", "n", F.explode(each).alias("e")).groupBy("e.name", "e.a.i")
                .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("e.a.d")).alias("d"), *[F.sum(F.col("n") * F.col("x")[j]).alias(f"s{j}") for j in range(len(cols))]).collect())
        for name, centres in list(now.items()):
            mine = {r["i"]: r for r in rows if r["name"] == name}
            new = [[mine[i][f"s{j}"] / mine[i]["n"] for j in range(len(cols))] if i in mine else c for i, c in enumerate(centres)]
            if [[round(v, digits) for v in c] for c in new] == [[round(v, digits) for v in c] for c in centres]:
                done[name] = centres, float(sum(r["d"] for r in mine.values()))
                del now[name]
            else:
                now[name] = new
    return done


def kmeans_from(df: DataFrame, cols: Sequence[str], k: int = 4, id_col: str = "author", seed: int = 42, label: str = "cluster") -> DataFrame:
    """M2 from seeded farthest-first centres: ``df`` with its cluster (numbered in the order of the first centres)."""
    centres = lloyd(df, cols, {k: farthest_first(df, cols, k, id_col, seed)})[k][0]
    return as_array(df, cols, "__x").withColumn(label, _nearest(F.col("__x"), centres)["i"]).drop("__x")


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(1, 11), id_col: str = "author", seed: int = 42) -> DataFrame:
    """M3: inertia per k, all k in the same steps."""
    picks = farthest_first(df, cols, max(ks), id_col, seed)
    found = lloyd(df, cols, {k: picks[:k] for k in ks}) if picks else {}
    return df.sparkSession.createDataFrame([(int(k), found[k][1] if k in found else None) for k in ks], "k int, inertia double")


def inertia_k1(df: DataFrame, cols: Sequence[str]) -> float:
    """k = 1 inertia in closed form: sum over columns of n * var_pop."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return float(sum((row[f"v{i}"] or 0.0) * row["n"] for i in range(len(cols))))


def kmeans_elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(1, 11), seed: int = 42) -> DataFrame:
    """M3: inertia per k. ML KMeans rejects k = 1, which is closed form."""
    spark = df.sparkSession
    feats = df.select(*cols).persist()
    rows = []
    for k in ks:
        if k == 1:
            rows.append((1, inertia_k1(feats, cols)))
        else:
            model, _ = kmeans(feats, cols, k, seed)
            rows.append((int(k), float(model.summary.trainingCost)))
    feats.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double")


# -- M6 / M7 / M8 ----------------------------------------------------------------------------------------


def cluster_membership_flatten(df: DataFrame, cluster_col: str, members_col: str) -> DataFrame:
    """M6: (cluster, [member, ...]) -> one (member, cluster, position) row each."""
    return df.select(F.col(cluster_col).alias("cluster"),
                     F.posexplode(members_col).alias("position", "member")).select("member", "cluster", "position")


def initial_medoids(df: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> list:
    """k distinct seeded picks: the k smallest md5(id || seed) (a top-k)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return [r[id_col] for r in df.select(id_col).orderBy(h, F.col(id_col)).limit(k).collect()]


def kmedoids(df: DataFrame, k: int, id_col: str = "id", x: str = "x", seed: int = 42,
             max_iter: int = 1000, medoids: Sequence | None = None):
    """M7: alternate k-medoids (assign to nearest medoid, then per cluster the
    member minimising the summed squared distance) until medoids are stable.

    Exact under squared Euclidean distance with O(n k) work per step (module
    docstring). Returns (medoid ids in cluster order, labelled DataFrame).
    """
    pts = df.select(id_col, x).persist()
    meds = list(medoids) if medoids is not None else initial_medoids(pts, k, id_col, seed)
    for _ in range(max_iter):
        coords = medoid_coords(pts, meds, id_col, x)
        lab = assign_nearest(pts, coords, x, digits=TIE_DIGITS)
        cents = dict(centres_from_labels(lab, x))
        # member nearest its centroid, ties by id: an aggregate, so it combines map-side
        lab2 = lab.withColumn("_cd", F.lit(None).cast("double"))
        for c, mu in cents.items():
            lab2 = lab2.withColumn("_cd", F.when(F.col("cluster") == c, F.round(_sqdist(F.col(x), mu), TIE_DIGITS)).otherwise(F.col("_cd")))
        best = (lab2.groupBy("cluster").agg(F.min(F.struct("_cd", id_col)).alias("m"))
                .select("cluster", F.col(f"m.{id_col}").alias("mid")).collect())
        new = list(meds)
        for r in best:
            new[r["cluster"]] = r["mid"]
        if new == meds:
            break
        meds = new
    else:
        pts.unpersist()
        raise RuntimeError(f"k-medoids has not converged after {max_iter} steps")
    coords = medoid_coords(pts, meds, id_col, x)
    out = assign_nearest(df, coords, x, digits=TIE_DIGITS)
    pts.unpersist()
    return meds, out


def medoid_coords(points: DataFrame, ids: Sequence, id_col: str = "id", x: str = "x") -> list[list[float]]:
    """M8: coordinates of the medoids, in the order of ``ids`` (k rows)."""
    rows = {r[id_col]: r[x] for r in points.where(F.col(id_col).isin(list(ids))).select(id_col, x).collect()}
    return [list(rows[i]) for i in ids]


def medoid_rows(points: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """M8 as a relation: points whose id is a medoid (semi join)."""
    return points.join(ids.select(id_col), id_col, "left_semi")
