"""Cart-abandonment model: feature table, exact stratified
split, Spark ML random forest with a quality gate, batch scoring of every
session, and risk bands.

Quirk kept from the reference: ``session_duration`` spans the whole session,
checkout and purchase included, so the label leaks into that feature.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import flags, history
from tidemark.plans.mart import session_mart
from tidemark.sources import schemas, versions
from tidemark.sources.io import AppTables

# The model's inputs, in order, and the forest's size.
FEATURES = [
    "session_duration",
    "num_products_viewed",
    "items_added_to_cart",
    "past_purchases_count",
    "discount_coupon_applied",
    "is_ios",
]
NUM_TREES, MAX_DEPTH = 100, 6
LABEL = "abandoned"


# --- K1 / C9 features ---------------------------------------------------------


def session_features(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """Feature columns and label for every session (carts or not)."""
    mart = mart if mart is not None else session_mart(tables)
    if tables.session_rollup is not None:
        known = history.with_prior_orders(mart)
    else:
        prior = history.prior_order_counts_by_day(tables.sessions, tables.orders)
        known = mart.join(prior, ["user_id", "session_date"], "left")
    return known.select(
        "session_id",
        "session_duration",
        F.col(flags.n_col("view_product")).alias("num_products_viewed"),
        F.col(flags.n_col("add_to_cart")).alias("items_added_to_cart"),
        "discount_coupon_applied",
        F.coalesce(F.col("past_purchases_count"), F.lit(0)).cast("bigint").alias("past_purchases_count"),
        F.when(F.col("device_type") == "iOS", F.lit(1)).otherwise(F.lit(0)).alias("is_ios"),
        F.when(F.col(flags.n_col("purchase")) > 0, F.lit(0)).otherwise(F.lit(1)).alias(LABEL),
    )


def cart_features(tables: AppTables, mart: DataFrame | None = None) -> DataFrame:
    """The training table: sessions with at least one Add To Cart event."""
    return session_features(tables, mart).filter(F.col("items_added_to_cart") > 0)


def feature_sample(features: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows of the feature matrix by session id, for
    inspection (a top-n: each partition keeps its own n before the merge)."""
    return features.orderBy("session_id").limit(n)


def past_purchases(tables: AppTables) -> DataFrame:
    """Per session: orders of the same user dated strictly before it."""
    if tables.session_rollup is None:
        return history.past_purchases(tables.sessions, tables.orders)
    known = history.with_prior_orders(session_mart(tables))
    return known.select("session_id", "user_id", "session_date", "past_purchases_count")


# --- K10 / K2 -------------------------------------------------------------------


def label_distribution(features: DataFrame) -> DataFrame:
    """Count and relative frequency of each label value (a window over the
    per-label rows only)."""
    counts = features.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(LABEL, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("fraction"))


def split_key(id_col: Column, seed: int) -> Column:
    """Deterministic pseudo-random order of rows: md5 of ``'{seed}:{id}'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


MAX_CLASSES = 1000  # classes a label may have unless the caller allows more


def _per_class(df: DataFrame, label_col: str, what: str, max_classes: int = MAX_CLASSES) -> list:
    """Collect a per-class table (one row per label value) after checking
    that it is small: its size is bounded by the number of classes."""
    rows = df.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{what}: more than {max_classes} distinct values of {label_col!r}")
    return rows


def _by_class(label_col: str, values: dict, default=None) -> Column:
    """CASE label WHEN v THEN values[v] … END — a per-class constant without a
    join (a join keyed by the label would put each class in one partition)."""
    expr = None
    for label, value in values.items():
        cond = F.col(label_col).isNull() if label is None else F.col(label_col) == F.lit(label)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def stratified_split(
    df: DataFrame,
    label_col: str = LABEL,
    id_col: str = "session_id",
    test_pct: int = 20,
    seed: int = 42,
    bucket_hex_digits: int = 5,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Exact stratified split: per label, the ``round(test_pct% · n_label)``
    rows with the smallest ``split_key`` are ``test``, the rest ``train``.
    Adds a ``split`` column.

    Scalable without a per-label window over all rows: the key's first hex
    digits define up to 16^5 buckets; a histogram per (label, bucket) and a
    running count over it (bounded by the bucket count) locate each label's
    cut bucket. Only that small per-class result reaches the driver; rows
    below the cut bucket are test, above it train, and only the cut bucket's
    few rows are ranked individually. That bucket holds about a 16^digits-th
    of a label: raise ``bucket_hex_digits`` (to 13 at most) with the rows of a
    label, so that one task can rank it.
    """
    key = split_key(F.col(id_col), seed)
    keyed = df.select(
        "*",
        key.alias("_split_key"),
        F.conv(F.substring(key, 1, bucket_hex_digits), 16, 10).cast("bigint").alias("_bucket"),
    )
    hist = keyed.groupBy(label_col, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    running = Window.partitionBy(label_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(
        label_col,
        "_bucket",
        "_cnt",
        F.sum("_cnt").over(running).alias("_cum"),
        F.sum("_cnt").over(Window.partitionBy(label_col)).alias("_n"),
    )
    x = F.col("_n") * F.lit(test_pct) + F.lit(50)
    k = ((x - x % 100) / 100).cast("bigint")
    cut = hist.withColumn("_k", k).filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_cnt") < F.col("_k")))
    cut_rows = _per_class(
        cut.select(label_col, "_bucket", (F.col("_k") - (F.col("_cum") - F.col("_cnt"))).alias("_take")),
        label_col,
        "stratified_split",
        max_classes,
    )
    # Labels without a cut bucket (k = 0) keep -1: every row is train.
    cut_bucket = _by_class(label_col, {r[0]: r[1] for r in cut_rows}, -1)
    take = _by_class(label_col, {r[0]: r[2] for r in cut_rows}, 0)
    labelled = keyed.select("*", cut_bucket.alias("_cut_bucket"), take.alias("_take"))
    at_cut = F.col("_bucket") == F.col("_cut_bucket")
    clear = labelled.filter(~at_cut).withColumn(
        "split", F.when(F.col("_bucket") < F.col("_cut_bucket"), F.lit("test")).otherwise(F.lit("train"))
    )
    rank = F.row_number().over(Window.partitionBy(label_col).orderBy("_split_key"))
    boundary = (
        labelled.filter(at_cut)
        .withColumn("_rank", rank)
        .withColumn("split", F.when(F.col("_rank") <= F.col("_take"), F.lit("test")).otherwise(F.lit("train")))
        .drop("_rank")
    )
    return clear.unionByName(boundary).drop("_split_key", "_bucket", "_cut_bucket", "_take")


# --- K3–K9 model ------------------------------------------------------------------


class QualityGateError(RuntimeError):
    """Raised when the test metrics are below the gate; nothing is saved."""


class NoTrainingRows(ValueError):
    """Raised when there is nothing to fit a model on; nothing is saved."""


@dataclass
class TrainedModel:
    model: PipelineModel
    metrics: DataFrame  # one row per metric: (metric, value)
    gate_passed: bool


def _class_weights(train: DataFrame, label_col: str) -> Column:
    """Balanced weights n / (n_classes · n_label) as a per-class constant
    expression (the per-class counts are a checked, class-sized result)."""
    counts = _per_class(train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")), label_col, "class weights")
    if not counts:
        raise NoTrainingRows("no rows to train on")
    total = sum(r["n"] for r in counts)
    weights = {r[label_col]: total / (len(counts) * r["n"]) for r in counts}
    return _by_class(label_col, weights, 1.0).cast("double")


def build_pipeline(num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, seed: int = 42) -> Pipeline:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="raw_features", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        featureSubsetStrategy="sqrt",
    )
    return Pipeline(stages=[assembler, scaler, forest])


def _model_input(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col(LABEL).cast("double").alias("label"),
    ).fillna(0, subset=["discount_coupon_applied"])


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy; precision / recall / F1 / support per class; their macro and
    support-weighted averages — from the confusion counts (one aggregation,
    no rows on the driver). ``f1_1`` is the F1 of the abandoned class, which
    the quality gate uses (not Spark's weighted ``f1``)."""
    conf = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    per_class = []
    for cls in (0.0, 1.0):
        tp = F.sum(F.when((F.col("label") == cls) & (F.col("prediction") == cls), F.col("n")).otherwise(0))
        pred = F.sum(F.when(F.col("prediction") == cls, F.col("n")).otherwise(0))
        actual = F.sum(F.when(F.col("label") == cls, F.col("n")).otherwise(0))
        c = int(cls)
        per_class += [
            (tp / F.nullif(pred, F.lit(0))).alias(f"precision_{c}"),
            (tp / F.nullif(actual, F.lit(0))).alias(f"recall_{c}"),
            (F.lit(2.0) * tp / F.nullif(pred + actual, F.lit(0))).alias(f"f1_{c}"),
            F.coalesce(actual, F.lit(0)).cast("double").alias(f"support_{c}"),
        ]
    correct = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    wide = conf.agg((correct / F.sum("n")).alias("accuracy"), *per_class)
    # Macro and support-weighted averages, as in a per-class report.
    support = F.col("support_0") + F.col("support_1")
    averages = []
    for m in ("precision", "recall", "f1"):
        a, b = F.coalesce(F.col(f"{m}_0"), F.lit(0.0)), F.coalesce(F.col(f"{m}_1"), F.lit(0.0))
        averages += [
            ((a + b) / F.lit(2.0)).alias(f"{m}_macro"),
            ((a * F.col("support_0") + b * F.col("support_1")) / F.nullif(support, F.lit(0.0))).alias(f"{m}_weighted"),
        ]
    wide = wide.select("*", *averages)
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in wide.columns]))
    )


def train_cart_model(
    split: DataFrame,
    min_accuracy: float | None = schemas.GATE_MIN_ACCURACY,
    min_f1: float | None = schemas.GATE_MIN_F1,
    model_path: str | None = None,
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = 42,
) -> TrainedModel:
    """Fit scaler + forest on the ``train`` rows of ``split`` (see
    ``stratified_split``) with balanced class weights, evaluate on its
    ``test`` rows, apply the gate, then (only if it passes) publish the pipeline
    and its metrics below ``model_path``. A gate bound of None disables it.

    The rows are persisted once (memory, spilling to disk) for the duration of
    the fit: the class counts, the scaler and every tree level re-read them."""
    data = _model_input(split).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = data.filter(F.col("split") == "train")
        train = train.withColumn("weight", _class_weights(train, LABEL))
        # A copy leaves out the training summary. That holds the SparkSession, which
        # can't go to tasks with the model once anything was observed in it.
        model = build_pipeline(num_trees, max_depth, seed).fit(train).copy()
        test = data.filter(F.col("split") == "test").withColumn("weight", F.lit(1.0))
        values = {r["metric"]: r["value"] for r in classification_metrics(model.transform(test)).collect()}
    finally:
        data.unpersist()
    metrics = split.sparkSession.createDataFrame(list(values.items()), "metric string, value double")
    passed = (min_accuracy is None or (values.get("accuracy") or 0.0) >= min_accuracy) and (
        min_f1 is None or (values.get("f1_1") or 0.0) >= min_f1
    )
    if not passed:
        raise QualityGateError(
            f"accuracy {values.get('accuracy')} / F1 {values.get('f1_1')} below gate {min_accuracy} / {min_f1}"
        )
    if model_path:
        publish_model(model, metrics, model_path)
    return TrainedModel(model=model, metrics=metrics, gate_passed=passed)


def publish_model(model: PipelineModel, metrics: DataFrame, path: str) -> int:
    """Save the pipeline and its metrics as a new version below ``path`` and
    point to it; until then, and if anything fails, the last version stays the
    one that is loaded. Gives the version."""
    spark = metrics.sparkSession
    folder = f"model-{uuid.uuid4().hex[:12]}"
    model.write().save(f"{path}/{folder}/pipeline")
    metrics.write.parquet(f"{path}/{folder}/metrics")
    return versions.publish(spark, path, {"model": folder})


def model_folder(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """Where a version's ``pipeline`` and ``metrics`` lie, the newest by
    default; None when nothing was published."""
    found = versions.content(spark, path, version)
    return None if found is None else f"{path}/{found['model']}"


def load_cart_model(spark: SparkSession, path: str, version: int | None = None) -> PipelineModel | None:
    """The published pipeline, or one saved at ``path`` itself; None when
    there is neither. A damaged or forbidden path is an error."""
    folder = model_folder(spark, path, version)
    if folder is not None:
        return PipelineModel.load(f"{folder}/pipeline")
    return PipelineModel.load(path) if versions.exists(spark, path) else None


def class_weights(split: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Per label of the train rows: their number and balanced weight (a window
    over the per-label rows only)."""
    counts = split.filter(F.col("split") == "train").groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select(label_col, "n", F.round(weight, 6).alias("weight"))


def feature_scaling(split: DataFrame) -> DataFrame:
    """Per feature, mean and sample deviation over the train rows: what the
    pipeline's scaler subtracts and divides by."""
    train = _model_input(split.filter(F.col("split") == "train"))
    wide = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.round(f"m_{c}", 6).alias("mean"), F.round(f"s_{c}", 6).alias("deviation"))
        for c in FEATURES
    ]
    return wide.select(F.inline(F.array(*rows)))


#: A rule in place of the forest, for checks of what surrounds it: a session is
#: predicted abandoned with fewer views than twice its cart items.
RULE_VIEWS_PER_ITEM = 2


def rule_report(split: DataFrame) -> DataFrame:
    """``classification_metrics`` of the rule on the test rows."""
    abandoned = F.col("num_products_viewed") < F.col("items_added_to_cart") * RULE_VIEWS_PER_ITEM
    test = _model_input(split.filter(F.col("split") == "test")).withColumn("prediction", abandoned.cast("double"))
    return classification_metrics(test).select("metric", F.round("value", 6).alias("value"))


# --- J18 scoring ------------------------------------------------------------------


def risk_band(risk: Column) -> Column:
    """HIGH above 70, MEDIUM above 40, else LOW (strict; unrounded risk)."""
    return (
        F.when(risk > F.lit(schemas.RISK_HIGH_ABOVE), F.lit("HIGH"))
        .when(risk > F.lit(schemas.RISK_MEDIUM_ABOVE), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def risk_action(risk: Column) -> Column:
    """Offer an incentive above 70, otherwise keep the checkout as is."""
    return F.when(risk > F.lit(schemas.RISK_HIGH_ABOVE), F.lit("offer")).otherwise(F.lit("maintain"))


def score_sessions(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """Abandonment risk for every session: 100.0 without the model when
    nothing was added to the cart, else P(abandoned) · 100; with band and
    action. Scoring is a map-only transform (no shuffle). Without a model
    (None) a session with cart items is an error."""
    scored = _model_input(features).withColumn("weight", F.lit(1.0))
    if model is None:
        prob = F.raise_error(F.lit("a session with cart items can't be scored without a model")).cast("double")
    else:
        scored = model.transform(scored)
        # A model fitted on bought carts alone has no class 1.
        prob = F.coalesce(F.get(vector_to_array(F.col("probability")), F.lit(1)), F.lit(0.0)) * F.lit(100.0)
    risk = F.when(F.col("items_added_to_cart") == 0, F.lit(100.0)).otherwise(prob)
    out = scored.select("session_id", *FEATURES, risk.alias("risk_pct"))
    return out.select("*", risk_band(F.col("risk_pct")).alias("risk_band"), risk_action(F.col("risk_pct")).alias("action"))


def rule_risk(features: DataFrame) -> DataFrame:
    """Risk bands over a rule's score (whole numbers from 0 to 100, so the
    bounds themselves occur): 100 without cart items, as the model's scores."""
    points = F.col("items_added_to_cart") * 10 + F.col("num_products_viewed") * 5 + F.col("is_ios") * 20
    risk = F.when(F.col("items_added_to_cart") == 0, F.lit(100.0)).otherwise(F.least(points, F.lit(100)).cast("double"))
    out = features.select("session_id", "items_added_to_cart", risk.alias("risk_pct"))
    return out.select("*", risk_band(F.col("risk_pct")).alias("risk_band"), risk_action(F.col("risk_pct")).alias("action"))


def model_metrics_report(tables: AppTables, seed: int = 42) -> DataFrame:
    """Train without the gate and report the test metrics plus the gate
    outcome as (metric, value) rows."""
    split = stratified_split(cart_features(tables), seed=seed)
    trained = train_cart_model(split, min_accuracy=None, min_f1=None, seed=seed)
    values = trained.metrics.agg(
        F.max(F.when(F.col("metric") == "accuracy", F.col("value"))).alias("a"),
        F.max(F.when(F.col("metric") == "f1_1", F.col("value"))).alias("f"),
    )
    gate = values.select(
        F.lit("gate_passed").alias("metric"),
        (
            (F.coalesce(F.col("a"), F.lit(0.0)) >= schemas.GATE_MIN_ACCURACY)
            & (F.coalesce(F.col("f"), F.lit(0.0)) >= schemas.GATE_MIN_F1)
        ).cast("double").alias("value"),
    )
    return trained.metrics.unionByName(gate)


def cart_risk_scores(tables: AppTables, seed: int = 42, model_path: str | None = None) -> DataFrame:
    """Score every session in batch with the model saved at ``model_path``;
    where there is none, train (no gate) on the cart sessions first, and save.
    Where there are no cart sessions either, no score needs a model."""
    features = session_features(tables)
    spark = features.sparkSession
    model = load_cart_model(spark, model_path) if model_path else None
    if model is None:
        split = stratified_split(features.filter(F.col("items_added_to_cart") > 0), seed=seed)
        try:
            model = train_cart_model(split, min_accuracy=None, min_f1=None, model_path=model_path, seed=seed).model
        except NoTrainingRows:
            model = None
    return score_sessions(model, features)
