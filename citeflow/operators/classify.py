"""Next-year activity classifier: M10-M18, S11, S12, A14.

Features and model are Spark ML stages, so fitting and scoring run on the
executors; evaluation is grouped aggregation. The network is Spark ML's
multilayer perceptron (sigmoid hidden units, softmax output, L-BFGS) in place
of a ReLU/dropout/Adam network: the closest built-in. Its weights are fitted
by ``perceptron``, which keeps the training vectors sparse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import ElementwiseProduct, FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.operators import perceptron
from citeflow.operators.cluster import standard_scale, standard_scale_fit
from citeflow.session import cut_lineage

NULL_CATEGORY = "\u0000null"   # null is a category of its own


def hash_bucket(col, buckets: int = 100) -> Column:
    """Partition-independent hash in [0, buckets): first 8 hex digits of md5."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def train_test_split(df: DataFrame, id_col: str, test_pct: int = 20, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Deterministic split by a hash of the row key (same in SQL)."""
    key = F.concat(F.col(id_col).cast("string"), F.lit(salt)) if salt else F.col(id_col)
    b = hash_bucket(key)
    return df.where(b >= test_pct), df.where(b < test_pct)


def one_hot_stages(cols: Sequence[str]) -> list:
    """Index + one-hot; unseen values -> all-zero vector (the 'keep'
    bucket is the dropped last slot)."""
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=f"{c}__s", outputCol=f"{c}__i", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__oh", dropLast=True))
    return stages


def prepare_categoricals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(f"{c}__s", F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY)))
    return df


def category_slots(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """M10 for any number of categories: (value, slot) of the distinct values in ascending order, and how many there are.

    Values are put in order by a range shuffle and numbered by their place in a partition plus a prefix sum over partitions;
    only one count a partition reaches the driver. Null is a category of its own.
    """
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(NULL_CATEGORY)).alias("value")).distinct()
    placed = cut_lineage(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()), "categories")
    counts = sorted((r.part, r.n) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "part long, before long")  # one row a partition
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
            .select("value", (F.col("before") + inside).alias("slot"))), total


def sparse_features(fit: DataFrame, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, int]:
    """M11 without hashing: scaled numerics, then one slot for each category that ``fit`` has of every column.

    Returns ``rows`` with ``indices`` and ``values`` (a sparse vector; unseen categories have no entry) in place of the
    features, and the length of the vectors. Each dictionary is joined to the rows; a category that many rows share repeats on
    the side that adaptive skew joins split.
    """
    stats = standard_scale_fit(fit, numeric)
    scaled = standard_scale(rows, numeric, "__z", stats)
    size, slots = len(numeric), []
    for i, c in enumerate(categorical):
        known, n = category_slots(fit, c)
        known = known.select(F.col("value").alias(f"__v{i}"), (F.col("slot") + size).alias(f"__s{i}"))
        scaled = scaled.withColumn(f"__v{i}", F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY))).join(known, f"__v{i}", "left").drop(f"__v{i}")
        slots.append(f"__s{i}")
        size += n
    hot = F.filter(F.array(*slots), lambda s: s.isNotNull()) if slots else F.array().cast("array<long>")
    out = scaled.withColumn("indices", F.concat(F.array(*[F.lit(i).cast("long") for i in range(len(numeric))]).cast("array<long>"), hot))
    out = out.withColumn("values", F.concat(F.array(*[F.col(f"{c}__z") for c in numeric]).cast("array<double>"), F.transform(hot, lambda s: F.lit(1.0))))
    return out.drop(*slots, *[f"{c}__z" for c in numeric]), size


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], hashed: Sequence[str] = (),
                     hash_features: int = 256, rows: int | None = None) -> list:
    """Scaled numerics ++ one-hot categoricals ++ hashed high-cardinality
    strings (a title is nearly unique per row, so one-hot would grow with the
    data). Scaling is by the population deviation: ``rows``, the number of
    rows to be fitted on, turns Spark's sample deviation into it."""
    factor = (rows / (rows - 1)) ** 0.5 if rows and rows > 1 else 1.0
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"),
              StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True),
              ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(numeric)), inputCol="_num_s", outputCol="_num_z")]
    stages += one_hot_stages(categorical)
    parts = ["_num_z"] + [f"{c}__oh" for c in categorical]
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol="_hashed", numFeatures=hash_features))
        parts.append("_hashed")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def mlp_classifier(n_features: int, hidden: Sequence[int] = (128, 64), max_iter: int = 50, seed: int = 42,
                   label: str = "label") -> MultilayerPerceptronClassifier:
    """M13."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed,
                                          labelCol=label, featuresCol="features", blockSize=128)


#: Bytes of dense vectors that a task of the multilayer perceptron holds and reads in every iteration.
TASK_BYTES = 256 << 20


def _prepared(train: DataFrame, numeric, categorical, hashed, label, hash_features) -> tuple[PipelineModel, DataFrame, int]:
    """Fitted preprocessing, the training vectors, and their length (from the column's metadata). Spark ML keeps them as dense blocks:
    where the session's shuffle partitions would hold more than ``TASK_BYTES`` of these, the vectors are spread over more tasks."""
    data = prepare_categoricals(train, categorical).withColumn(label, F.col(label).cast("double"))
    rows = data.count()
    pre = Pipeline(stages=feature_pipeline(numeric, categorical, hashed, hash_features, rows)).fit(data)
    vectors = pre.transform(data).select(label, "features")
    size = int(vectors.schema["features"].metadata["ml_attr"]["num_attrs"])
    tasks = -(-rows * size * 8 // TASK_BYTES)
    if tasks > int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        vectors = vectors.repartition(tasks)
    return pre, vectors, size


def fit_classifier(train: DataFrame, numeric, categorical, hashed=(), label: str = "label",
                   max_iter: int = 50, hash_features: int = 256, seed: int = 42) -> PipelineModel:
    """Fit preprocessing + MLP as one PipelineModel; its ``objectives`` are the training loss at the start and after each iteration."""
    pre, vectors, n = _prepared(train, numeric, categorical, hashed, label, hash_features)
    estimator = mlp_classifier(n, max_iter=max_iter, seed=seed, label=label)
    weights, objectives = None, []
    for weights, loss in perceptron.train(vectors, estimator):
        objectives.append(loss)
    model = PipelineModel(stages=[*pre.stages, perceptron.model_of(train.sparkSession, estimator, weights)])
    model.objectives = objectives
    return model


def score(model: PipelineModel, df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Probability of the positive class as ``p``."""
    out = model.transform(prepare_categoricals(df, categorical))
    return out.withColumn("p", vector_to_array("probability")[1])


def network_data(train: DataFrame, test: DataFrame, numeric, categorical, hashed=(), label: str = "label", id_col: str = "work_id",
                 hash_features: int = 256, validation_pct: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature vectors of the fit, validation (a salted hash split of ``train``) and test rows, by one preprocessing that is
    fitted on the fit rows: id, label, features."""
    fit_part, val_part = train_test_split(train, id_col, validation_pct, salt="/validation")
    pre, _, _ = _prepared(fit_part, numeric, categorical, hashed, label, hash_features)
    made = lambda df: pre.transform(prepare_categoricals(df, categorical)).select(id_col, F.col(label).cast("double").alias(label), "features")
    return made(fit_part), made(val_part), made(test)


def loss_history(model: PipelineModel) -> list[float]:
    """The optimiser's objective per iteration (train loss) of a model that ``fit_classifier`` made."""
    return list(model.objectives)


def validation_curve(train: DataFrame, numeric, categorical, hashed=(), label: str = "label",
                     steps: Sequence[int] = (5, 10, 20, 30, 40, 50), validation_pct: int = 20,
                     seed: int = 42, id_col: str = "work_id") -> DataFrame:
    """M14 (with A14 as its minimum): training objective and validation loss
    after n optimiser iterations, for each n in ``steps``.

    One run: the weights after n iterations are those of a fit with
    ``maxIter = n`` (the last ones, if it ends before). They are scored on a held-out ``validation_pct`` share (hash split
    with a salt, as the page's 20% validation split). Validation loss is reported as mean absolute error (the
    page's loss) and as log-loss; both are aggregates over the scored rows.
    """
    fit_part, val_part = train_test_split(train, id_col, validation_pct, salt="/validation")
    spark = train.sparkSession
    pre, vectors, size = _prepared(fit_part, numeric, categorical, hashed, label, 256)
    held = cut_lineage(pre.transform(prepare_categoricals(val_part, categorical)).select(F.col(label).cast("double").alias("y"), "features"), "held-out")
    estimator = mlp_classifier(size, max_iter=int(max(steps)), seed=seed, label=label)
    reached = {}
    for i, (weights, loss) in enumerate(perceptron.train(vectors, estimator)):
        reached.update({int(n): (weights, loss) for n in steps if int(n) >= i})
    rows = []
    for n in steps:
        weights, loss = reached.get(int(n), (None, None))
        p, y = vector_to_array("probability")[1], F.col("y")
        pc = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
        m = perceptron.model_of(spark, estimator, weights).transform(held).agg(
            F.avg(F.abs(y - p)).alias("mae"), F.avg(-(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("ll")).first()
        rows.append((int(n), loss, m["mae"], m["ll"]))
    return spark.createDataFrame(rows, "iterations int, train_objective double, val_mae double, val_logloss double")


def save_model(model: PipelineModel, path: str) -> None:
    """Overwrite if present."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S12."""
    return PipelineModel.load(path)


# -- evaluation (M15-M17) -----------------------------------------------------------


def predict_threshold(df: DataFrame, p: str = "p", threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """Class 1 when p > threshold."""
    return df.withColumn(out, (F.col(p) > F.lit(threshold)).cast("int"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro
    and weighted averages (0 where a denominator is 0). One grouped count of
    the confusion cells; the rest is arithmetic on at most 4 rows."""
    cm = df.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("yhat")) \
        .agg(F.count(F.lit(1)).alias("n"))
    # the cells of all class pairs as one array in one row; the rest is arithmetic on it
    cells = cm.agg(F.collect_list(F.struct("y", "yhat", "n")).alias("cells"))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def total(cond):
        return F.aggregate(F.filter("cells", cond), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])

    classes = F.array_sort(F.array_distinct(F.concat(F.transform("cells", lambda x: x["y"]), F.transform("cells", lambda x: x["yhat"]))))
    per = cells.select(F.transform(classes, lambda c: F.struct(
        c.alias("c"), total(lambda x: (x["y"] == c) & (x["yhat"] == c)).alias("tp"),
        total(lambda x: x["yhat"] == c).alias("pred_n"), total(lambda x: x["y"] == c).alias("support"))).alias("per"))

    def row(name, precision, recall, f1, support):
        return F.struct(name.alias("class"), precision.cast("double").alias("precision"), recall.cast("double").alias("recall"),
                        f1.cast("double").alias("f1"), support.cast("long").alias("support"))

    def scored(x):
        p, r = div(x["tp"], x["pred_n"]), div(x["tp"], x["support"])
        return row(x["c"].cast("string"), p, r, div(2 * p * r, p + r), x["support"])

    def sum_of(f):
        return F.aggregate("rows", F.lit(0.0), lambda acc, x: acc + f(x))

    per = per.select("per", F.transform("per", scored).alias("rows"))
    n = F.aggregate("per", F.lit(0).cast("long"), lambda acc, x: acc + x["support"])
    hits = F.aggregate("per", F.lit(0).cast("long"), lambda acc, x: acc + x["tp"])
    names = ("precision", "recall", "f1")
    summary = F.array(row(F.lit("accuracy"), F.lit(None), F.lit(None), div(hits, n), n),
                      row(F.lit("macro avg"), *[div(sum_of(lambda x, c=c: x[c]), F.size("rows")) for c in names], n),
                      row(F.lit("weighted avg"), *[div(sum_of(lambda x, c=c: x[c] * x["support"]), n) for c in names], n))
    return per.select(F.inline(F.concat("rows", summary)))


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Exclusive running sums of ``value_cols`` in ``order_col`` order, without
    a single-task window over the rows: range-partition, written once with the
    partition's number; a window inside each partition, plus the totals of the
    partitions before it (one row a partition, so broadcasting them is bounded).
    ``order_col`` must be unique (pre-aggregate first)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id()), "running")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy("_pid").agg(*[F.sum(c).alias(f"_{c}") for c in value_cols])
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in value_cols])
    w = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = r.join(F.broadcast(offsets), "_pid")
    for c in value_cols:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_{c}"))
    return out.drop("_pid", *[f"_{c}" for c in value_cols])


def roc_auc(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Exact ROC AUC (ties count one half), as the rank-sum statistic:
    sum over distinct scores s of pos(s) * (neg below s + neg(s)/2) / (P N).
    Scores are pre-aggregated, and the running negative count is a
    distributed prefix sum (no single-task window). Null if all rows are of one class."""
    hist = df.groupBy(F.col(p).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    rt = running_totals(hist, "s", ["neg"])
    return rt.agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
                   / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
