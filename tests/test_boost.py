"""Boosting by hand, its stop, and folds beside one another."""

import math

import pytest
from pyspark.sql import functions as F

from antecede.modelling import boost
from antecede.modelling.boost import fit_boosted, score_boosted
from antecede.modelling.model import boosted_learner, out_of_fold
from antecede.modelling.prep import quantiles, quantiles_without

SCHEMA = "id int, x double, y int, valid boolean"


def softmax(scores):
    powers = [math.exp(s - max(scores)) for s in scores]
    return [p / sum(powers) for p in powers]


def test_first_round_by_hand(spark):
    # x = 0: classes 0, 0, 1; x = 1: classes 1, 1, 1.  Shares: 2/6 and 4/6.
    rows = [(i, float(x), y, False) for i, (x, y) in enumerate([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1)])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_boosted(df, ["x"], "y", 2, F.col("valid"), rounds=1, rate=0.5)
    assert model.prior == pytest.approx((math.log(1 / 3), math.log(2 / 3)))
    step = {0: (2 / 3 - 1 / 3) / (2 / 9), 1: (0 - 1 / 3) / (2 / 9)}  # mean residual over p (1 - p), class 0
    want = {x: softmax([math.log(1 / 3) + 0.5 * s, math.log(2 / 3) - 0.5 * s]) for x, s in step.items()}
    got = {r.x: r.scores for r in score_boosted(model, df, ["x"]).collect()}
    for x in (0, 1):
        assert got[x] == pytest.approx(want[x])
    loss = -(2 * math.log(want[0][0]) + math.log(want[0][1]) + 3 * math.log(want[1][1])) / 6
    assert model.rounds[0].train_loss == pytest.approx(loss) and model.rounds[0].valid_loss is None and model.best == 1


@pytest.fixture(scope="module")
def noisy(spark):
    # x tells nothing about the validation rows' classes: the loss there only grows.
    rows = [(i, float(i % 4), int(i % 4 < 2), i % 3 == 0) for i in range(60)]
    rows = [(i, x, y if not v else (i // 3) % 2, v) for i, x, y, v in rows]
    return spark.createDataFrame([*rows, (99, 1.0, None, False), (98, 1.0, 7, False)], SCHEMA)


def test_stops_after_the_patience(noisy):
    model = fit_boosted(noisy, ["x"], "y", 2, F.col("valid"), rounds=20, patience=3, rate=0.5)
    losses = [r.valid_loss for r in model.rounds]
    assert len(losses) == model.best + 3 < 20 and min(losses) == losses[model.best - 1]
    train = [r.train_loss for r in model.rounds]
    assert train == sorted(train, reverse=True)
    kept = score_boosted(model, noisy.where("valid"), ["x"])
    loss = kept.agg(F.avg(-F.ln(F.get("scores", F.col("y"))))).first()[0]
    assert loss == pytest.approx(losses[model.best - 1])  # the trees after the best round are gone


def test_labels_that_are_no_class(spark, noisy):
    got = score_boosted(fit_boosted(noisy, ["x"], "y", 3, F.col("valid"), rounds=2), noisy, ["x"])
    assert got.count() == 62 and all(len(r.scores) == 3 and abs(sum(r.scores) - 1) < 1e-9 for r in got.collect())
    with pytest.raises(ValueError):
        fit_boosted(noisy.where("valid"), ["x"], "y", 2, F.col("valid"))


def test_equal_rows_are_one_row_with_a_weight(spark, monkeypatch):
    rows = [(i, float(i % 4), int(i % 4 < 2) if i % 7 else 1, i % 3 == 0) for i in range(840)]
    kept, store = [], boost.stored
    monkeypatch.setattr(boost, "stored", lambda df: kept.append((found := store(df))[0].count()) or found)
    model = fit_boosted(spark.createDataFrame(rows, SCHEMA), ["x"], "y", 2, F.col("valid"), rounds=2, rate=0.5)
    different = {r[1:] for r in rows}
    assert kept == [len(different)] * 4
    scores = {x: [math.log(sum(r[2] == k for r in rows if not r[3]) / 560) for k in (0, 1)] for x in range(4)}
    for made in model.rounds:
        for x, s in scores.items():
            p, own = softmax(s), [r[2] for r in rows if r[1] == x and not r[3]]
            scores[x] = [s[k] + 0.5 * (own.count(k) / len(own) - p[k]) / (p[k] * (1 - p[k])) for k in (0, 1)]
        for held, loss in ((False, made.train_loss), (True, made.valid_loss)):
            own = [-math.log(softmax(scores[x])[y]) for _, x, y, v in rows if v == held]
            assert loss == pytest.approx(sum(own) / len(own))


def test_a_least_number_of_rows_in_a_leaf(spark):
    df = spark.createDataFrame([(i, float(i % 2), i % 2, False) for i in range(6)], SCHEMA)
    for least, parts in ((3, 2), (4, 1)):  # equal rows count each
        model = fit_boosted(df, ["x"], "y", 2, F.col("valid"), rounds=1, params={"minInstancesPerNode": least})
        assert len({tuple(r.scores) for r in score_boosted(model, df, ["x"]).collect()}) == parts


def test_quantiles_outside_each_fold(spark):
    rows = [(i % 3, float((i * 37) % 101), None if i % 5 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, a double, b double").repartition(6)
    got = {(r.without, r["col"], r.prob): r.value for r in quantiles_without(df, ["a", "b"], "fold", [0, 1, 2]).collect()}
    want = {
        (f, r["col"], r.prob): r.value for f in range(3) for r in quantiles(df.where(F.col("fold") != f), ["a", "b"]).collect()
    }
    assert got == want and len(got) == 18


def test_boosted_folds(spark):
    rows = [(i, i % 3, float(i % 7), float(i % 2), int(i % 7 > 3)) for i in range(210)]
    df = spark.createDataFrame(rows, "id int, fold int, a double, b double, y int")
    held_out, averaged = out_of_fold(
        df, ["a", "b"], "y", "id", to_score=df.where("id < 20"), learner=boosted_learner(2, rounds=3, patience=2, rate=0.5), at_once=3
    )
    got = held_out.collect()
    assert sorted(r.id for r in got) == list(range(210)) and all(r.predicted == r.y for r in got)
    assert averaged.count() == 20
