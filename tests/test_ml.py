"""Split exactness, quality gate, persistence and batch scoring."""

from __future__ import annotations

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import event, make_tables, order, session, user
from tidemark.plans import forest, ml
from tidemark.sources import versions
from tidemark.sources.driver_data import load_app_tables


def brute_force_split(rows, test_pct=20, seed=42):
    by_label = {}
    for sid, label in rows:
        by_label.setdefault(label, []).append(sid)
    out = {}
    for label, ids in by_label.items():
        ids.sort(key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        k = (len(ids) * test_pct + 50) // 100
        for rank, sid in enumerate(ids):
            out[sid] = "test" if rank < k else "train"
    return out


@pytest.mark.parametrize("digits", [1, 2, 5])
@pytest.mark.parametrize("n,pos_every", [(2000, 3), (7, 2), (1, 1)])
def test_split_matches_brute_force(spark, digits, n, pos_every):
    rows = [(i, 1 if i % pos_every == 0 else 0) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id long, abandoned int")
    got = {r["session_id"]: r["split"] for r in ml.stratified_split(df, bucket_hex_digits=digits).collect()}
    assert got == brute_force_split(rows)


@pytest.fixture(scope="module")
def small(spark):
    return load_app_tables(spark, SF_SMALL)


def test_gate_blocks_saving(spark, small):
    feats = ml.cart_features(small)
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    with pytest.raises(ml.QualityGateError):
        ml.train_cart_model(ml.stratified_split(feats), min_accuracy=1.01, min_f1=None, model_path=path, num_trees=5)
    assert ml.load_cart_model(spark, path) is None


def test_learnable_data_passes_the_gate(spark):
    """Sessions whose duration tells the label: the default gate must let them through."""
    planted = spark.range(600).select(
        F.col("id").alias("session_id"),
        F.when(F.col("id") % 3 == 0, 30 + F.col("id") % 50).otherwise(400 + F.col("id") % 90).alias("session_duration"),
        (F.col("id") % 7).alias("num_products_viewed"),
        (F.col("id") % 4 + 1).alias("items_added_to_cart"),
        (F.col("id") % 5).alias("past_purchases_count"),
        F.when(F.col("id") % 6 > 0, F.col("id") % 2).cast("int").alias("discount_coupon_applied"),
        (F.col("id") % 2).cast("int").alias("is_ios"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("abandoned"),
    )
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    trained = ml.train_cart_model(ml.stratified_split(planted), model_path=path, num_trees=10)
    metrics = {r["metric"]: r["value"] for r in trained.metrics.collect()}
    assert trained.gate_passed and metrics["accuracy"] >= 0.8 and metrics["f1_1"] >= 0.8
    assert ml.load_cart_model(spark, path) is not None


@pytest.fixture
def observed(spark):
    """A session that holds what can't be sent to tasks, as after any observation."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    return spark


def test_metrics_after_an_observation(observed, small):
    metrics = {r["metric"]: r["value"] for r in ml.model_metrics_report(small).collect()}
    assert metrics["support_0"] + metrics["support_1"] > 0 and metrics["gate_passed"] in (0.0, 1.0)


def test_scores_after_an_observation(observed, small):
    scores = ml.cart_risk_scores(small)
    assert scores.filter(F.col("risk_pct").between(0, 100)).count() == small.sessions.count()


def carts(spark, added, bought):
    """Twelve one-day sessions; ``added`` and ``bought`` tell by number whether
    a session has an Add To Cart and a Purchase."""
    ids = range(1, 13)
    events = [event(i, i, "View Product") for i in ids]
    events += [event(i, i, "Add To Cart", seconds=5) for i in ids if added(i)]
    events += [event(i, i, "Purchase", seconds=9) for i in ids if bought(i)]
    return make_tables(
        spark, [user(i) for i in ids], [session(i, i) for i in ids], events, [order(i, i, i, 10) for i in ids if bought(i)]
    )


@pytest.mark.parametrize("bought", [lambda i: True, lambda i: i % 2])
def test_scores_where_no_session_has_a_cart(spark, bought):
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    tables = carts(spark, lambda i: False, bought)
    got = {r.session_id: (r.risk_pct, r.risk_band, r.action) for r in ml.cart_risk_scores(tables, model_path=path).collect()}
    assert got == {i: (100.0, "HIGH", "offer") for i in range(1, 13)}
    assert ml.load_cart_model(spark, path) is None


def test_scores_without_any_session(spark):
    assert ml.cart_risk_scores(make_tables(spark)).collect() == []


@pytest.mark.parametrize("all_bought", [True, False])
def test_scores_where_all_carts_end_alike(spark, all_bought):
    tables = carts(spark, lambda i: i > 4, lambda i: all_bought and i > 4)
    got = {r.session_id: (r.risk_pct, r.risk_band, r.action) for r in ml.cart_risk_scores(tables).collect()}
    carted = (0.0, "LOW", "maintain") if all_bought else (100.0, "HIGH", "offer")
    assert got == {i: carted if i > 4 else (100.0, "HIGH", "offer") for i in range(1, 13)}


def test_carts_need_a_model(spark):
    features = ml.session_features(carts(spark, lambda i: i == 1, lambda i: False))
    with pytest.raises(Exception, match="without a model"):
        ml.score_sessions(None, features).collect()


def test_a_damaged_model_is_an_error(spark):
    path = tempfile.mkdtemp(prefix="tidemark-model-")
    os.makedirs(os.path.join(path, "metadata"))
    with pytest.raises(Exception, match="."):
        ml.load_cart_model(spark, path)


def test_risk_bands_are_strict(spark):
    rows = [(1, 0, 0, 0), (2, 7, 0, 0), (3, 7, 0, 1), (4, 4, 0, 0), (5, 4, 1, 0), (6, 30, 30, 1)]
    df = spark.createDataFrame(rows, "session_id long, items_added_to_cart long, num_products_viewed long, is_ios int")
    got = [tuple(r)[2:] for r in ml.rule_risk(df).orderBy("session_id").collect()]
    assert got == [
        (100.0, "HIGH", "offer"), (70.0, "MEDIUM", "maintain"), (90.0, "HIGH", "offer"),
        (40.0, "LOW", "maintain"), (45.0, "MEDIUM", "maintain"), (100.0, "HIGH", "offer"),
    ]


def test_scores_come_from_the_saved_model(spark, small):
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    first = ml.cart_risk_scores(small, model_path=path).orderBy("session_id").collect()
    stamp = versions.numbers(spark, path)
    assert ml.cart_risk_scores(small, model_path=path).orderBy("session_id").collect() == first
    assert versions.numbers(spark, path) == stamp == [1]  # not fitted again


def test_train_save_load_score(spark, small):
    feats_all = ml.session_features(small)
    feats = feats_all.filter(F.col("items_added_to_cart") > 0)
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    trained = ml.train_cart_model(ml.stratified_split(feats), min_accuracy=None, min_f1=None, model_path=path, num_trees=10)
    metrics = {r["metric"]: r["value"] for r in trained.metrics.collect()}
    assert 0.0 <= metrics["accuracy"] <= 1.0 and "f1_1" in metrics
    model = ml.load_cart_model(spark, path)
    assert model is not None
    scored = ml.score_sessions(model, feats_all)
    assert scored.count() == feats_all.count()
    no_cart = scored.filter(F.col("items_added_to_cart") == 0).select("risk_pct", "risk_band", "action").distinct()
    assert [tuple(r) for r in no_cart.collect()] in ([], [(100.0, "HIGH", "offer")])
    assert scored.filter((F.col("risk_pct") < 0) | (F.col("risk_pct") > 100)).count() == 0


def test_a_failed_save_keeps_the_published_model(spark, small, monkeypatch):
    split = ml.stratified_split(ml.cart_features(small))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    first = ml.train_cart_model(split, None, None, model_path=path, num_trees=3)
    old = ml.model_folder(spark, path)
    stored = spark.read.parquet(f"{old}/metrics")
    assert sorted(stored.collect()) == sorted(first.metrics.collect())

    def fails(*_):
        raise OSError("no room")

    with monkeypatch.context() as broken:
        broken.setattr(versions, "publish", fails)  # after the new folder is written
        with pytest.raises(OSError, match="no room"):
            ml.train_cart_model(split, None, None, model_path=path, num_trees=2)
    assert ml.model_folder(spark, path) == old
    assert ml.load_cart_model(spark, path).stages[-1].getNumTrees == 3
    ml.train_cart_model(split, None, None, model_path=path, num_trees=2)
    assert ml.load_cart_model(spark, path).stages[-1].getNumTrees == 2
    assert ml.load_cart_model(spark, path, version=1).stages[-1].getNumTrees == 3


def test_scores_equal_the_node_table(spark, small):
    """Every session's probability, from the stored nodes by joins alone."""
    features = ml.session_features(small)
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-model-"), "m")
    split = ml.stratified_split(features.filter(F.col("items_added_to_cart") > 0))
    model = ml.train_cart_model(split, None, None, model_path=path, num_trees=12).model
    saved = f"{ml.model_folder(spark, path)}/pipeline"
    nodes = forest.forest_nodes(spark, saved)
    by_nodes = {r[0]: r[1] for r in forest.score_by_nodes(features, nodes, *forest.scaling(spark, saved)).collect()}
    scored = ml.score_sessions(model, features).collect()
    assert len(scored) == len(by_nodes) > 0
    for r in scored:
        risk = 100.0 if r.items_added_to_cart == 0 else 100.0 * by_nodes[r.session_id]
        assert abs(r.risk_pct - risk) <= 1e-7  # 1e-9 as a probability
        band = "HIGH" if risk > 70 else "MEDIUM" if risk > 40 else "LOW"
        assert min(abs(risk - 70), abs(risk - 40)) < 1e-7 or r.risk_band == band


def test_per_class_tables_are_size_checked(spark):
    n = (ml.MAX_CLASSES + 1) * 5  # five rows per class, so every class has a cut bucket
    df = spark.range(n).select(F.col("id").alias("session_id"), (F.col("id") % (ml.MAX_CLASSES + 1)).alias("abandoned"))
    with pytest.raises(ValueError):
        ml.stratified_split(df)


def test_classification_metrics_against_hand_counts(spark):
    # label, prediction: TP(1)=3, FN(1)=1, FP(1)=2, TN=4
    rows = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 4
    m = {r["metric"]: r["value"] for r in ml.classification_metrics(spark.createDataFrame(rows, "label double, prediction double")).collect()}
    assert m["accuracy"] == pytest.approx(0.7)
    assert m["precision_1"] == pytest.approx(3 / 5) and m["recall_1"] == pytest.approx(3 / 4)
    assert m["f1_1"] == pytest.approx(2 * 3 / (5 + 4))
    assert m["precision_0"] == pytest.approx(4 / 5) and m["recall_0"] == pytest.approx(4 / 6)
    assert m["support_0"] == 6 and m["support_1"] == 4
    assert m["f1_macro"] == pytest.approx((m["f1_0"] + m["f1_1"]) / 2)
    assert m["recall_weighted"] == pytest.approx(0.7)  # weighted recall equals accuracy
