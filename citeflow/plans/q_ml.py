"""Queries of the clustering (M1-M8) and classifier (M10-M18) pages."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from citeflow.functions import scalars as S
from citeflow.operators import classify as C
from citeflow.operators import cluster as K
from citeflow.operators import network as N
from citeflow.operators import works as W
from citeflow.plans import bindings as B
from citeflow.plans.catalog import SQL_WORKS, register, sql
from citeflow.session import scratch_path

N_CLUSTERS = 4      # the page's default slider value
SEED = 42


def author_features(spark, d):
    """(author, publications, total_cites): the k-means input of the page."""
    return W.count_and_sum(B.works_orders(spark, d))


def scaled_features(spark, d):
    f = author_features(spark, d)
    return K.standard_scale(f, ["publications", "total_cites"])


SQL_FEAT = """feat AS (SELECT author, count(*) AS publications, CAST(sum(cites) AS BIGINT) AS total_cites FROM works GROUP BY author)"""


@register("standard_scale", sql(SQL_WORKS, SQL_FEAT, body="""
SELECT author,
       round(CASE WHEN stddev_pop(publications) OVER () > 0
                  THEN (publications - avg(publications) OVER ()) / stddev_pop(publications) OVER () ELSE 0 END, 6) AS publications_z,
       round(CASE WHEN stddev_pop(total_cites) OVER () > 0
                  THEN (total_cites - avg(total_cites) OVER ()) / stddev_pop(total_cites) OVER () ELSE 0 END, 6) AS total_cites_z
FROM feat"""))
def q_standard_scale(spark, d):
    z = scaled_features(spark, d)
    return z.select("author", F.round("publications_z", 6).alias("publications_z"),
                    F.round("total_cites_z", 6).alias("total_cites_z"))


@register("kmeans_inertia_k1", sql(SQL_WORKS, SQL_FEAT, """
z AS (SELECT (publications - avg(publications) OVER ()) / stddev_pop(publications) OVER () AS a,
             (total_cites - avg(total_cites) OVER ()) / stddev_pop(total_cites) OVER () AS b FROM feat)""",
body="SELECT round(count(*) * (var_pop(a) + var_pop(b)), 4) AS inertia FROM z"))
def q_kmeans_inertia_k1(spark, d):
    z = scaled_features(spark, d)
    v = K.inertia_k1(z, ["publications_z", "total_cites_z"])
    return z.sparkSession.range(1).select(F.round(F.lit(v), 4).alias("inertia"))


SQL_SCALED = """
scaled AS (SELECT author AS id, (publications - avg(publications) OVER ()) / stddev_pop(publications) OVER () AS x,
                  (total_cites - avg(total_cites) OVER ()) / stddev_pop(total_cites) OVER () AS y FROM feat)"""
SQL_COMBINED = """
patents AS (SELECT upper('u' || CAST(user_id AS VARCHAR)) AS inventor, event_id AS patent FROM events WHERE event_type = 'purchase'),
joined AS (SELECT coalesce(w.author, p.inventor) AS author, coalesce(w.publications, 0) AS publications, coalesce(p.patents, 0) AS patents
           FROM (SELECT 'U' || CAST(author AS VARCHAR) AS author, count(*) AS publications FROM works GROUP BY 1) w
           FULL OUTER JOIN (SELECT inventor, count(DISTINCT patent) AS patents FROM patents GROUP BY inventor) p ON w.author = p.inventor),
scaled AS (SELECT author AS id, (publications - avg(publications) OVER ()) / stddev_pop(publications) OVER () AS x,
                  (patents - avg(patents) OVER ()) / stddev_pop(patents) OVER () AS y FROM joined)"""


def sql_first(k):
    """Farthest-first centres of ``scaled``: f1 ... fk."""
    out = [f"f1 AS (SELECT x, y FROM scaled ORDER BY md5(CAST(id AS VARCHAR) || '{SEED}'), CAST(id AS VARCHAR) LIMIT 1)"]
    for j in range(2, k + 1):
        far = ", ".join(f"(s.x - f{i}.x) ^ 2 + (s.y - f{i}.y) ^ 2" for i in range(1, j))
        out.append(f"f{j} AS (SELECT s.x, s.y FROM scaled s, {', '.join(f'f{i}' for i in range(1, j))} "
                   f"ORDER BY round(least({far}, 1e300), 9) DESC, CAST(s.id AS VARCHAR) LIMIT 1)")
    return ",\n".join(out)


def sql_steps(k):
    """k-means steps from f1 ... fk until the centres stay: cs{k} (one list of centres), lab{k} (id, x, y, cluster, d)."""
    near = lambda cs: f"(SELECT arg_min(j, (s.x - {cs}[j + 1][1]) ^ 2 + (s.y - {cs}[j + 1][2]) ^ 2) FROM range({k}) t(j))"
    rounded = lambda c: f"list_transform({c}, lambda v: [round(v[1], 9), round(v[2], 9)])"
    return f"""
rec{k} AS (
  SELECT 0 AS step, list([x, y] ORDER BY c) AS cs FROM ({' UNION ALL '.join(f'SELECT {i} AS c, x, y FROM f{i + 1}' for i in range(k))})
  UNION ALL
  SELECT step + 1, new FROM (
    SELECT step, cs, list([nx, ny] ORDER BY c) AS new
    FROM (SELECT step, cs, c, avg(x) AS nx, avg(y) AS ny FROM (SELECT r.step, r.cs, s.x, s.y, {near('r.cs')} AS c FROM rec{k} r, scaled s) GROUP BY step, cs, c)
    GROUP BY step, cs)
  WHERE {rounded('new')} <> {rounded('cs')}),
cs{k} AS (SELECT cs FROM rec{k} ORDER BY step DESC LIMIT 1),
lab{k} AS (SELECT id, x, y, c AS cluster, (x - cs[c + 1][1]) ^ 2 + (y - cs[c + 1][2]) ^ 2 AS d
           FROM (SELECT s.id, s.x, s.y, cs, {near('cs')} AS c FROM scaled s, cs{k}))"""


def sql_kmeans(scaled, body, ks=(N_CLUSTERS,)):
    parts = [SQL_WORKS, *([SQL_FEAT] if scaled is SQL_SCALED else []), scaled, sql_first(max(ks)), *(sql_steps(k) for k in ks)]
    return sql(*parts, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


SELECT_CLUSTERS = f"SELECT id AS author, CAST(cluster AS INTEGER) AS cluster FROM lab{N_CLUSTERS}"


@register("kmeans_authors", sql_kmeans(SQL_SCALED, SELECT_CLUSTERS))
def q_kmeans_authors(spark, d):
    return K.kmeans_from(scaled_features(spark, d), ["publications_z", "total_cites_z"], N_CLUSTERS, "author", SEED).select("author", "cluster")


@register("kmeans_ml_authors")
def q_kmeans_ml_authors(spark, d):
    """M2 by Spark ML (k-means|| first centres)."""
    _model, lab = K.kmeans(scaled_features(spark, d), ["publications_z", "total_cites_z"], N_CLUSTERS, SEED)
    return lab.select("author", "cluster")


@register("kmeans_elbow", sql_kmeans(SQL_COMBINED, " UNION ALL ".join(f"SELECT {k} AS k, round(sum(d), 4) AS inertia FROM lab{k}" for k in range(1, 11)), range(1, 11)))
def q_kmeans_elbow(spark, d):
    """M3 on the page's input, scaled (publications, patents) per author: all k in the same steps."""
    found = K.elbow(combined_features(spark, d), ["publications_z", "patents_z"], range(1, 11), "author", SEED)
    return found.select("k", F.round("inertia", 4).alias("inertia"))


def combined_features(spark, d):
    """J2 output scaled: works per author full-outer distinct patents per
    inventor, zeros filled, then (publications, patents) z-scores."""
    from citeflow.operators import timeline as T
    works = B.works_orders(spark, d).withColumn("author", F.concat(F.lit("U"), F.col("author").cast("string")))
    left = W.count_and_sum(works)
    right = W.distinct_patents(B.patents_events(spark, d)).withColumnRenamed("inventor", "author")
    j = T.outer_join_fill(left, right, "author", ["publications", "total_cites", "patents"])
    return K.standard_scale(j, ["publications", "patents"])


@register("standard_scale_combined", sql(SQL_WORKS, """
patents AS (SELECT upper('u' || CAST(user_id AS VARCHAR)) AS inventor, event_id AS patent FROM events WHERE event_type = 'purchase'),
j AS (SELECT coalesce(w.author, p.inventor) AS author, coalesce(w.publications, 0) AS publications, coalesce(p.patents, 0) AS patents
      FROM (SELECT 'U' || CAST(author AS VARCHAR) AS author, count(*) AS publications FROM works GROUP BY 1) w
      FULL OUTER JOIN (SELECT inventor, count(DISTINCT patent) AS patents FROM patents GROUP BY inventor) p
      ON w.author = p.inventor)""", body="""
SELECT author,
       round(CASE WHEN stddev_pop(publications) OVER () > 0
                  THEN (publications - avg(publications) OVER ()) / stddev_pop(publications) OVER () ELSE 0 END, 6) AS publications_z,
       round(CASE WHEN stddev_pop(patents) OVER () > 0
                  THEN (patents - avg(patents) OVER ()) / stddev_pop(patents) OVER () ELSE 0 END, 6) AS patents_z
FROM j"""))
def q_standard_scale_combined(spark, d):
    z = combined_features(spark, d)
    return z.select("author", F.round("publications_z", 6).alias("publications_z"),
                    F.round("patents_z", 6).alias("patents_z"))


@register("kmeans_combined", sql_kmeans(SQL_COMBINED, SELECT_CLUSTERS))
def q_kmeans_combined(spark, d):
    """M2 on the second data set of the page: (publications, patents)."""
    return K.kmeans_from(combined_features(spark, d), ["publications_z", "patents_z"], N_CLUSTERS, "author", SEED).select("author", "cluster")


def sql_medoids(k, first):
    """k-medoids steps on ``scaled`` from the ids of ``first`` (rank, id) until the medoids stay: med (id, cluster)."""
    near = lambda ms: f"(SELECT arg_min(j, [round((s.x - {ms}[j + 1].x) ^ 2 + (s.y - {ms}[j + 1].y) ^ 2, 9), j]) FROM range({k}) t(j))"
    point = "struct_pack(id := id, x := x, y := y)"
    ids = lambda ms: f"list_transform({ms}, lambda v: v.id)"
    return f"""
first AS ({first}),
recm AS (
  SELECT 0 AS step, list({point} ORDER BY rank) AS ms FROM first JOIN scaled USING (id)
  UNION ALL
  SELECT step + 1, new FROM (
    SELECT step, ms, list_transform(range({k}), lambda j: coalesce(list_filter(list(struct_pack(c := c, p := {point})), lambda b: b.c = j)[1].p, ms[j + 1])) AS new FROM (
      SELECT *, row_number() OVER (PARTITION BY c ORDER BY cd, id) AS place FROM (
        SELECT *, round((x - avg(x) OVER (PARTITION BY c)) ^ 2 + (y - avg(y) OVER (PARTITION BY c)) ^ 2, 9) AS cd
        FROM (SELECT r.step, r.ms, s.id, s.x, s.y, {near('r.ms')} AS c FROM recm r, scaled s)))
    WHERE place = 1 GROUP BY step, ms)
  WHERE {ids('new')} <> {ids('ms')}),
med AS (SELECT s.id, {near('ms')} AS cluster FROM scaled s, (SELECT ms FROM recm ORDER BY step DESC LIMIT 1))"""


SELECT_MEDOIDS = "SELECT id AS author, CAST(cluster AS INTEGER) AS cluster FROM med"
FIRST_MEDOIDS = f"""SELECT row_number() OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR) || '{SEED}'), o_custkey) AS rank, o_custkey AS id
  FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY rank LIMIT {N_CLUSTERS}"""


def _recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("kmedoids_combined", _recursive(sql(SQL_WORKS, SQL_COMBINED, sql_medoids(
    N_CLUSTERS, f"SELECT rank, 'U' || CAST(id AS VARCHAR) AS id FROM ({FIRST_MEDOIDS})"), body=SELECT_MEDOIDS)))
def q_kmedoids_combined(spark, d):
    """M7 on (publications, patents), seeded with the *same* authors as the
    first data set's medoids, as the page reuses its initial indices."""
    first = K.as_array(scaled_features(spark, d), ["publications_z", "total_cites_z"])
    seeds = ["U" + str(a) for a in K.initial_medoids(first, N_CLUSTERS, "author", SEED)]
    z = K.as_array(combined_features(spark, d), ["publications_z", "patents_z"])
    _meds, lab = K.kmedoids(z, N_CLUSTERS, "author", "x", SEED, medoids=seeds)
    return lab.select("author", "cluster")


SQL_CENTRES = """pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
dims AS (SELECT label, i, avg(x[i]) AS m FROM pts, range(1, 65) t(i) GROUP BY label, i),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY label)"""


@register("assign_nearest", sql(SQL_CENTRES, body="""
SELECT vec_id, cluster, round(sqdist, 6) AS sqdist FROM (
  SELECT p.vec_id, arg_min(c.label, [list_distance(p.x, c.c) ^ 2, c.label]) AS cluster,
         min(list_distance(p.x, c.c) ^ 2) AS sqdist
  FROM pts p CROSS JOIN cent c GROUP BY p.vec_id)"""))
def q_assign_nearest(spark, d):
    pts = K.as_array(B.table(spark, d, "embeddings"), "embedding")
    cents = K.centres_from_labels(pts, "x", "label")
    out = K.assign_nearest(pts, [c for _, c in cents], "x", ids=[lab for lab, _ in cents])
    return out.select("vec_id", "cluster", F.round("sqdist", 6).alias("sqdist"))


@register("silhouette_sq", """
WITH pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
pair AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x) ^ 2) AS tot
         FROM pts a JOIN pts b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
per AS (SELECT p.vec_id, p.own,
               max(CASE WHEN p.other = p.own THEN p.tot / (s.n - 1) END) AS a,
               min(CASE WHEN p.other <> p.own THEN p.tot / s.n END) AS b
        FROM pair p JOIN sizes s ON s.label = p.other GROUP BY 1, 2),
allp AS (SELECT pts.vec_id, pts.label, per.a, per.b, sizes.n FROM pts JOIN sizes USING (label)
         LEFT JOIN per ON per.vec_id = pts.vec_id)
SELECT round(avg(CASE WHEN n <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette_sq
FROM allp""")
def q_silhouette_sq(spark, d):
    pts = K.as_array(B.table(spark, d, "embeddings"), "embedding")
    return K.silhouette_sq(pts, "x", "label").select(F.round("silhouette_sq", 6).alias("silhouette_sq"))


SQL_SILHOUETTE = """
sizes AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
pair AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS tot
         FROM pts a JOIN pts b ON a.id <> b.id GROUP BY 1, 2, 3),
per AS (SELECT p.id, p.own,
               max(CASE WHEN p.other = p.own THEN p.tot / (s.n - 1) END) AS a,
               min(CASE WHEN p.other <> p.own THEN p.tot / s.n END) AS b
        FROM pair p JOIN sizes s ON s.label = p.other GROUP BY 1, 2),
allp AS (SELECT pts.id, pts.label, per.a, per.b, sizes.n FROM pts JOIN sizes USING (label) LEFT JOIN per ON per.id = pts.id)"""
SELECT_SILHOUETTE = """
SELECT round(avg(CASE WHEN n <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM allp"""


@register("silhouette_vectors", sql("pts AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)", SQL_SILHOUETTE,
                                    body=SELECT_SILHOUETTE))
def q_silhouette_vectors(spark, d):
    """M5 (Euclidean) of the embeddings with their labels as clusters."""
    pts = K.as_array(B.table(spark, d, "embeddings"), "embedding")
    return K.silhouette(pts, "x", "label").select(F.round("silhouette", 6).alias("silhouette"))


@register("silhouette_bands", sql(SQL_WORKS, SQL_FEAT, """
pts AS (SELECT author AS id, CAST(publications // 4 AS INTEGER) AS label, [CAST(publications AS DOUBLE), CAST(total_cites AS DOUBLE)] AS x FROM feat)""",
SQL_SILHOUETTE, body=SELECT_SILHOUETTE))
def q_silhouette_bands(spark, d):
    """M5 (Euclidean) of authors by (publications, citations), with bands of four publications as clusters."""
    f = K.as_array(author_features(spark, d), ["publications", "total_cites"]).withColumn("label", F.floor(F.col("publications") / 4).cast("int"))
    return K.silhouette(f, "x", "label").select(F.round("silhouette", 6).alias("silhouette"))


SQL_PTS = f"pts AS (SELECT id, cluster AS label, [x, y] AS x FROM lab{N_CLUSTERS})"
SQUARED = (SQL_SILHOUETTE.replace("list_distance(a.x, b.x)", "list_distance(a.x, b.x) ^ 2"), SELECT_SILHOUETTE.replace("silhouette", "silhouette_sq"))


def sql_scored(scaled, silhouette=SQL_SILHOUETTE, body=SELECT_SILHOUETTE):
    """The silhouette of the k-means clusters of ``scaled``, from all pairs."""
    parts = [SQL_WORKS, *([SQL_FEAT] if scaled is SQL_SCALED else []), scaled, sql_first(N_CLUSTERS), sql_steps(N_CLUSTERS), SQL_PTS, silhouette]
    return sql(*parts, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def _clustered(spark, d, combined=False):
    """The page's k-means clusters with their points as ``x``."""
    z, cols = (combined_features(spark, d), ["publications_z", "patents_z"]) if combined else (scaled_features(spark, d), ["publications_z", "total_cites_z"])
    return K.as_array(K.kmeans_from(z, cols, N_CLUSTERS, "author", SEED), cols)


@register("silhouette_kmeans", sql_scored(SQL_SCALED))
def q_silhouette_kmeans(spark, d):
    """M2 + M5 (Euclidean): the page's number for k-means on scaled author features."""
    return K.silhouette(_clustered(spark, d), "x", "cluster").select(F.round("silhouette", 6).alias("silhouette"))


@register("silhouette_combined", sql_scored(SQL_COMBINED, *SQUARED))
def q_silhouette_combined(spark, d):
    """M2 + M5 (squared) on (publications, patents)."""
    return K.silhouette_sq(_clustered(spark, d, combined=True), "x", "cluster").select(F.round("silhouette_sq", 6).alias("silhouette_sq"))


@register("silhouette_kmedoids", _recursive(sql(SQL_WORKS, SQL_FEAT, SQL_SCALED, sql_medoids(N_CLUSTERS, FIRST_MEDOIDS),
                                                "pts AS (SELECT id, cluster AS label, [x, y] AS x FROM med JOIN scaled USING (id))",
                                                SQL_SILHOUETTE, body=SELECT_SILHOUETTE)))
def q_silhouette_kmedoids(spark, d):
    """M7 + M5 (Euclidean): the page's number for k-medoids on scaled author features."""
    z = K.as_array(scaled_features(spark, d), ["publications_z", "total_cites_z"])
    _meds, lab = K.kmedoids(z, N_CLUSTERS, "author", "x", SEED)
    return K.silhouette(lab, "x", "cluster").select(F.round("silhouette", 6).alias("silhouette"))


@register("silhouette_authors", sql_scored(SQL_SCALED, *SQUARED))
def q_silhouette_authors(spark, d):
    """M2 + M5 (squared): silhouette of the page's k-means on scaled author features."""
    return K.silhouette_sq(_clustered(spark, d), "x", "cluster").select(F.round("silhouette_sq", 6).alias("silhouette_sq"))


@register("cluster_membership_flatten", """
WITH lists AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS lst FROM lineitem GROUP BY l_orderkey)
SELECT unnest(lst) AS member, l_orderkey AS cluster, unnest(range(len(lst))) AS position FROM lists""")
def q_cluster_membership_flatten(spark, d):
    li = B.table(spark, d, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("members"))
    return K.cluster_membership_flatten(lists, "l_orderkey", "members")


@register("medoid_coords", """
SELECT vec_id, embedding FROM embeddings
WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '42'), vec_id LIMIT 4)""")
def q_medoid_coords(spark, d):
    e = B.table(spark, d, "embeddings")
    ids = K.initial_medoids(e, N_CLUSTERS, "vec_id", SEED)
    return K.medoid_rows(e.select("vec_id", "embedding"), spark.createDataFrame([(i,) for i in ids], "vec_id long"),
                         "vec_id")


@register("kmedoids_authors", _recursive(sql(SQL_WORKS, SQL_FEAT, SQL_SCALED, sql_medoids(N_CLUSTERS, FIRST_MEDOIDS), body=SELECT_MEDOIDS)))
def q_kmedoids_authors(spark, d):
    z = K.as_array(scaled_features(spark, d), ["publications_z", "total_cites_z"])
    _meds, lab = K.kmedoids(z, N_CLUSTERS, "author", "x", SEED)
    return lab.select("author", "cluster")


@register("kmedoids_embeddings")
def q_kmedoids_embeddings(spark, d):
    pts = K.as_array(B.table(spark, d, "embeddings"), "embedding").withColumnRenamed("vec_id", "id")
    _meds, lab = K.kmedoids(pts, 10, "id", "x", SEED)
    return lab.select("id", "cluster", F.round("sqdist", 6).alias("sqdist"))


# -- classifier ----------------------------------------------------------------------------

CATEGORICAL = ["o_orderstatus", "o_orderpriority"]
HASHED = ["title", "author_s"]


def publications(spark, d):
    """works ⋈ per-order citation cells by year: the classifier's table."""
    works = B.works_orders(spark, d)
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), "o_orderstatus", "o_orderpriority")
    years = sorted({*B.ship_years(spark, d), B.TARGET_YEAR})
    cells = B.cells_by_year(spark, d, years, F.col("l_orderkey").alias("work_id"))
    t = works.join(o, "work_id").join(cells, "work_id", "left")
    for y in years:
        t = t.withColumn(str(y), S.fill_zero(F.col(f"`{y}`")).cast("double"))
    return (t.withColumn("label", W.binary_target(str(B.TARGET_YEAR)).cast("int"))
            .withColumn("author_s", F.col("author").cast("string")))


def numeric(pubs):
    """Numeric features: citations, yearly mean, and the year columns before the target year."""
    return ["cites", "avg_per_year", *W.year_columns(pubs.columns, hi=B.TARGET_YEAR - 1)]


def _trained(spark, d, max_iter=50):
    pubs = publications(spark, d)
    train, test = C.train_test_split(pubs, "work_id")
    model = C.fit_classifier(train, numeric(pubs), CATEGORICAL, HASHED, "label", max_iter=max_iter)
    return model, pubs, train, test


@register("train_test_split", sql(SQL_WORKS, body="""
SELECT work_id, CASE WHEN CAST(('0x' || substr(md5(CAST(work_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20
                     THEN 'test' ELSE 'train' END AS split FROM works"""))
def q_train_test_split(spark, d):
    w = B.works_orders(spark, d)
    train, test = C.train_test_split(w, "work_id")
    return (train.select("work_id", F.lit("train").alias("split"))
            .unionByName(test.select("work_id", F.lit("test").alias("split"))))


@register("one_hot", """
WITH split AS (SELECT o_orderkey AS work_id, o_orderpriority, o_orderstatus,
                      CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20 AS test FROM orders),
p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (SELECT DISTINCT o_orderpriority AS v FROM split WHERE NOT test)),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (SELECT DISTINCT o_orderstatus AS v FROM split WHERE NOT test))
SELECT work_id, CAST(coalesce(p.slot, -1) AS INTEGER) AS o_orderpriority_slot, CAST(coalesce(s.slot, -1) AS INTEGER) AS o_orderstatus_slot
FROM split LEFT JOIN p ON p.v = o_orderpriority LEFT JOIN s ON s.v = o_orderstatus WHERE test""")
def q_one_hot(spark, d):
    """M10 on columns with few categories (others are hashed): fitted on the train split, applied to the test split; the
    hot slot per column, -1 when the value was never seen (all-zero vector)."""
    from pyspark.ml import Pipeline
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), "o_orderpriority", "o_orderstatus")
    train, test = C.train_test_split(o, "work_id")
    cols = ["o_orderpriority", "o_orderstatus"]
    m = Pipeline(stages=C.one_hot_stages(cols)).fit(C.prepare_categoricals(train, cols))
    out = m.transform(C.prepare_categoricals(test, cols))

    def hot(c):
        a = vector_to_array(f"{c}__oh")
        return F.coalesce(F.array_position(a, 1.0).cast("int") - 1, F.lit(-1))
    return out.select("work_id", *[F.when(hot(c) < 0, -1).otherwise(hot(c)).alias(f"{c}_slot") for c in cols])


@register("category_slots", """
WITH split AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20 AS test FROM orders),
vals AS (SELECT 'title' AS feature, CAST(o_orderkey AS VARCHAR) AS value FROM split WHERE NOT test
         UNION SELECT 'author', CAST(o_custkey AS VARCHAR) FROM split WHERE NOT test
         UNION SELECT 'priority', o_orderpriority FROM split WHERE NOT test)
SELECT feature, value, dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS slot FROM vals""")
def q_category_slots(spark, d):
    """The dictionaries of a unique column, an author column and one of few values, fitted on the train split."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderkey").cast("string").alias("title"),
                                           F.col("o_custkey").cast("string").alias("author"), F.col("o_orderpriority").alias("priority"))
    train, _test = C.train_test_split(o, "work_id")
    parts = [C.category_slots(train, c)[0].select(F.lit(c).alias("feature"), "value", "slot") for c in ("title", "author", "priority")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("sparse_features", sql(SQL_WORKS, """
split AS (SELECT w.work_id, w.title, CAST(w.author AS VARCHAR) AS author, o.o_orderpriority AS priority, CAST(w.cites AS DOUBLE) AS cites, w.avg_per_year,
                 CAST(('0x' || substr(md5(CAST(w.work_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20 AS test
          FROM works w JOIN orders o ON w.work_id = o.o_orderkey),
fit AS (SELECT * FROM split WHERE NOT test),
stats AS (SELECT avg(cites) AS m1, stddev_pop(cites) AS s1, avg(avg_per_year) AS m2, stddev_pop(avg_per_year) AS s2 FROM fit),
t AS (SELECT value, row_number() OVER (ORDER BY value) + 1 AS slot FROM (SELECT DISTINCT title AS value FROM fit)),
a AS (SELECT value, row_number() OVER (ORDER BY value) + 1 + (SELECT count(*) FROM t) AS slot FROM (SELECT DISTINCT author AS value FROM fit)),
p AS (SELECT value, row_number() OVER (ORDER BY value) + 1 + (SELECT count(*) FROM t) + (SELECT count(*) FROM a) AS slot
      FROM (SELECT DISTINCT priority AS value FROM fit))""", body="""
SELECT work_id, md5(concat_ws(',', CAST(round((cites - m1) / s1 * 10000) AS BIGINT), CAST(round((avg_per_year - m2) / s2 * 10000) AS BIGINT),
                              t.slot, a.slot, p.slot)) AS features_md5
FROM split CROSS JOIN stats LEFT JOIN t ON t.value = title LEFT JOIN a ON a.value = author LEFT JOIN p ON p.value = priority"""))
def q_sparse_features(spark, d):
    """M11 with every title and author as a category: md5 of the scaled values (four decimals) and the hot slots."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("priority"))
    works = B.works_orders(spark, d).withColumn("author", F.col("author").cast("string")).join(o, "work_id")
    train, _test = C.train_test_split(works, "work_id")
    numeric_cols = ["cites", "avg_per_year"]
    rows, _size = C.sparse_features(train, works, numeric_cols, ["title", "author", "priority"])
    n = len(numeric_cols)
    shown = F.concat(F.transform(F.slice("values", 1, n), lambda v: F.round(v * 10000).cast("long")), F.expr(f"slice(indices, {n + 1}, size(indices))"))
    return rows.select("work_id", F.md5(F.array_join(F.transform(shown, lambda v: v.cast("string")), ",")).alias("features_md5"))


@register("feature_pipeline")
def q_feature_pipeline(spark, d):
    from pyspark.ml import Pipeline
    pubs = C.prepare_categoricals(publications(spark, d), CATEGORICAL)
    m = Pipeline(stages=C.feature_pipeline(numeric(pubs), CATEGORICAL, HASHED, rows=pubs.count())).fit(pubs)
    out = m.transform(pubs)
    a = vector_to_array("features")
    return out.select("work_id", F.size(a).alias("n_features"),
                      F.size(F.filter(a, lambda v: v != 0)).alias("non_zero"))


@register("mlp_classifier")
def q_mlp_classifier(spark, d):
    model, _pubs, _train, test = _trained(spark, d)
    s = C.predict_threshold(C.score(model, test, CATEGORICAL))
    return s.select("work_id", "label", "prediction", F.round("p", 6).alias("p"))


@register("loss_history")
def q_loss_history(spark, d):
    model, *_ = _trained(spark, d)
    h = C.loss_history(model)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(h)], "iteration int, loss double")


EPOCHS = 10         # the page's least slider value


def _network(spark, d, epochs=EPOCHS):
    """(folder of epoch states, validation rows, test rows) of the page's network."""
    pubs = publications(spark, d)
    train, test = C.train_test_split(pubs, "work_id")
    fit, val, test = C.network_data(train, test, numeric(pubs), CATEGORICAL, HASHED)
    return N.train(fit, val, epochs), val, test


@register("network_classifier")
def q_network_classifier(spark, d):
    """M13 + M15: the page's network, trained and applied to the test split."""
    folder, _val, test = _network(spark, d)
    s = C.predict_threshold(N.score(test, N.state_of(spark, folder, EPOCHS)[0]))
    return s.select("work_id", F.col("label").cast("int").alias("label"), "prediction", F.round("p", 6).alias("p"))


@register("network_history")
def q_network_history(spark, d):
    """Training and validation loss, one row an epoch, all from one run."""
    folder, _val, _test = _network(spark, d)
    return N.history(spark, folder)


@register("network_scores_valid", """
WITH split AS (SELECT o_orderkey AS work_id, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20 AS test FROM orders)
SELECT work_id, true AS is_probability, true AS loss_agrees, true AS least_is_least FROM split WHERE test""")
def q_network_scores_valid(spark, d):
    """What holds whatever the weights are: every test row has one probability; the validation loss of the
    last epoch is that of its saved weights; the least loss (A14) is not above any epoch's."""
    folder, val, test = _network(spark, d, epochs=2)
    weights, _ = N.state_of(spark, folder, 2)
    losses = {r.epoch: r.val_loss for r in N.history(spark, folder).collect()}
    again = N.score(val, weights).agg(F.avg(F.abs(F.col("label") - F.col("p")))).first()[0]
    least = N.history(spark, folder).agg(F.min("val_loss")).first()[0]
    return N.score(test, weights).select("work_id", F.col("p").between(0, 1).alias("is_probability"),
                                         F.lit(abs(again - losses[2]) < 1e-9).alias("loss_agrees"),
                                         F.lit(all(least <= x for x in losses.values())).alias("least_is_least"))


@register("min_over_history")
def q_min_over_history(spark, d):
    """The least validation loss (mean absolute error) over the epochs of the network's one run."""
    return q_network_history(spark, d).agg(F.min("val_loss").alias("min_val_loss"))


@register("validation_curve")
def q_validation_curve(spark, d):
    """M14 train + validation loss by iteration count (A14, the page's
    minimum validation loss, is the minimum of ``val_mae`` here)."""
    pubs = publications(spark, d)
    train, _test = C.train_test_split(pubs, "work_id")
    return C.validation_curve(train, numeric(pubs), CATEGORICAL, HASHED, "label", steps=(5, 10, 20, 35, 50))


@register("score_author")
def q_score_author(spark, d):
    """M18 for every author: mean, max and first-row (by work id) probability."""
    model, pubs, *_ = _trained(spark, d)
    s = C.score(model, pubs, CATEGORICAL)
    return (s.groupBy("author").agg(F.avg("p").alias("mean_p"), F.max("p").alias("max_p"),
                                    F.min_by("p", "work_id").alias("first_p"))
            .select("author", *[F.round(S.score_percent(c), 4).alias(c) for c in ("mean_p", "max_p", "first_p")]))


@register("model_write_read", """
SELECT o_orderkey AS work_id, true AS same FROM orders
WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20""")
def q_model_write_read(spark, d):
    """S11 + S12: save (twice: overwriting is allowed) to the shared folder, load, and compare the scores of the test
    split before and after."""
    model, _pubs, _train, test = _trained(spark, d, max_iter=5)
    path = scratch_path(spark, "model")
    C.save_model(model, path)
    C.save_model(model, path)
    before = C.score(model, test, CATEGORICAL).select("work_id", F.col("p").alias("p0"))
    after = C.score(C.load_model(path), test, CATEGORICAL).select("work_id", F.col("p").alias("p1"))
    return before.join(after, "work_id").select("work_id", (F.col("p0") == F.col("p1")).alias("same"))


# -- evaluation on the scored documents (given p) ------------------------------------------------

SQL_SCORED = """scored AS (SELECT l.doc_id, l.quality AS label, d.n_chars / (d.n_chars + 5000.0) AS p
                 FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@register("predict_threshold", sql(SQL_SCORED, body="SELECT doc_id, label, CAST(p > 0.5 AS INTEGER) AS prediction FROM scored"))
def q_predict_threshold(spark, d):
    return C.predict_threshold(B.scored_docs(spark, d)).select("doc_id", "label", "prediction")


@register("score_percent", sql(SQL_SCORED, body="SELECT doc_id, round(p * 100, 6) AS score FROM scored"))
def q_score_percent(spark, d):
    return B.scored_docs(spark, d).select("doc_id", F.round(S.score_percent("p"), 6).alias("score"))


@register("classification_report", sql(SQL_SCORED, """
pr AS (SELECT label AS y, CAST(p > 0.5 AS INTEGER) AS yhat FROM scored),
cls AS (SELECT y AS c FROM pr UNION SELECT yhat FROM pr),
per AS (SELECT c,
               (SELECT count(*) FROM pr WHERE y = c AND yhat = c) AS tp,
               (SELECT count(*) FROM pr WHERE yhat = c) AS pred_n,
               (SELECT count(*) FROM pr WHERE y = c) AS support FROM cls),
m AS (SELECT CAST(c AS VARCHAR) AS class,
             CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support, tp FROM per),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)""",
body="""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support) FROM m2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), sum(support) FROM m2"""))
def q_classification_report(spark, d):
    r = C.classification_report(C.predict_threshold(B.scored_docs(spark, d)))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


@register("roc_auc", sql(SQL_SCORED, """
r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scored)""",
body="""SELECT round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) AS auc FROM r"""))
def q_roc_auc(spark, d):
    return C.roc_auc(B.scored_docs(spark, d)).select(F.round("auc", 6).alias("auc"))
