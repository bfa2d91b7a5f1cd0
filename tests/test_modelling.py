import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.modelling.metrics import log_loss, quadratic_kappa
from antecede.modelling.model import average_scores, fit_classifier, out_of_fold, score, submission
from antecede.modelling.prep import folds, holdout, quantiles, robust_apply, robust_fit


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.expovariate(1) ** 5, float(rnd.randrange(3)), 7.0, None if i % 3 else float(i)) for i in range(1501)]
    return rows, spark.createDataFrame(rows, "id int, wide double, ties double, flat double, holes double").repartition(5)


def test_quantiles_are_exact(numbers):
    rows, df = numbers
    got = {(r["col"], r["prob"]): r["value"] for r in quantiles(df, ["wide", "ties", "flat", "holes"], [0.0, 0.1, 0.5, 0.75, 1.0]).collect()}
    for i, name in enumerate(["wide", "ties", "flat", "holes"], 1):
        values = [r[i] for r in rows if r[i] is not None]
        for p in (0.0, 0.1, 0.5, 0.75, 1.0):
            assert got[(name, p)] == pytest.approx(np.quantile(values, p), rel=1e-12), (name, p)


def test_quantiles_of_a_few_rows(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert {r["prob"]: r["value"] for r in quantiles(df, ["v"]).collect()} == {0.25: 1.75, 0.5: 2.5, 0.75: 4.75}


def test_robust_scaling_leaves_flat_columns_unscaled(numbers):
    rows, df = numbers
    cols = ["wide", "ties", "flat"]
    out = robust_apply(df, robust_fit(df, cols), cols)
    assert out.columns == df.columns
    q1, q2, q3 = np.quantile([r[1] for r in rows], [0.25, 0.5, 0.75])
    for r in out.where("id < 5").collect():
        assert r["flat"] == 0.0
        assert r["wide"] == pytest.approx((rows[r["id"]][1] - q2) / (q3 - q1))


def test_holdout_depends_on_the_key_alone(numbers):
    _, df = numbers
    one = {r["id"]: r["is_holdout"] for r in holdout(df, "id").collect()}
    two = {r["id"]: r["is_holdout"] for r in holdout(df.repartition(2).orderBy("wide"), "id").collect()}
    assert one == two and 0.2 < np.mean(list(one.values())) < 0.3
    assert one != {r["id"]: r["is_holdout"] for r in holdout(df, "id", seed=1).collect()}


def test_folds_are_balanced_in_every_label(numbers):
    _, df = numbers
    out = folds(df.withColumn("label", (F.col("id") % 7 == 0).cast("int")), "label", "id", k=10)
    sizes = out.groupBy("label", "fold").count().collect()
    assert len(sizes) == 20
    for label in (0, 1):
        mine = [r["count"] for r in sizes if r["label"] == label]
        assert max(mine) - min(mine) <= 1
    again = {r["id"]: r["fold"] for r in folds(df.repartition(3).withColumn("label", (F.col("id") % 7 == 0).cast("int")), "label", "id").collect()}
    assert again == {r["id"]: r["fold"] for r in out.collect()}


def kappa_by_table(y, p, k):
    seen = np.zeros((k, k))
    for a, b in zip(y, p):
        seen[a, b] += 1
    weights = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)])
    expected = np.outer(seen.sum(1), seen.sum(0)) / len(y)
    return 1 - (weights * seen).sum() / (weights * expected).sum()


def test_kappa_equals_the_confusion_table_form(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.randrange(4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p int")
    assert quadratic_kappa(df, "y", "p").first()[0] == pytest.approx(kappa_by_table(*zip(*rows), 4), rel=1e-12)
    assert quadratic_kappa(df, "y", "y").first()[0] == 1.0
    assert quadratic_kappa(df.where("y = 1"), "y", "y").first()[0] is None


def test_average_scores_class_by_class(spark):
    a = spark.createDataFrame([("k", [0.2, 0.8]), ("m", [1.0, 0.0])], "key string, scores array<double>")
    b = spark.createDataFrame([("k", [0.4, 0.6])], "key string, scores array<double>")
    got = {r["key"]: r["scores"] for r in average_scores([a, b], "key").collect()}
    assert got["k"] == pytest.approx([0.3, 0.7]) and got["m"] == [1.0, 0.0]


def test_submission_matches_by_user(spark):
    scores = spark.createDataFrame([("b", [0.1, 0.9]), ("a", [0.9, 0.1])], "installation_id string, scores array<double>")
    template = spark.createDataFrame([("a",), ("b",), ("c",)], "installation_id string")
    assert {tuple(r) for r in submission(scores, template).collect()} == {("a", 0), ("b", 1), ("c", None)}
    assert {tuple(r) for r in submission(scores, template, default=3).collect()} == {("a", 0), ("b", 1), ("c", 3)}


@pytest.fixture(scope="module")
def labelled_points(spark):
    rnd = random.Random(9)
    rows = [(f"s{i}", i % 4, i % 4 + rnd.random() * 0.4, rnd.random()) for i in range(240)]
    return spark.createDataFrame(rows, "id string, y int, a double, b double")


def test_a_forest_learns_and_scores_every_class(labelled_points):
    parts = holdout(labelled_points, "id")
    model = fit_classifier(parts.where("NOT is_holdout"), ["a", "b"], "y", {"numTrees": 5, "maxDepth": 4})
    scored = score(model, parts.where("is_holdout"), ["a", "b"])
    assert quadratic_kappa(scored, "y", "predicted").first()[0] > 0.9
    assert 0 <= log_loss(scored, "y").first()[0] < 1
    assert scored.where("size(scores) <> 4").count() == 0


def test_out_of_fold_scores_each_row_once(labelled_points):
    placed = folds(labelled_points, "y", "id", k=2)
    held_out, averaged = out_of_fold(placed, ["a", "b"], "y", "id", to_score=labelled_points.limit(10), params={"numTrees": 3, "maxDepth": 3})
    rows = held_out.collect()
    assert len(rows) == 240 and len({r["id"] for r in rows}) == 240
    assert averaged.count() == 10
