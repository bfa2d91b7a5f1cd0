"""Train and test matrices on a small log of the game."""

import pytest

from antecede.plans.eligibility import eligible_train
from antecede.plans import matrix as M
from antecede.plans import tape
from antecede.plans.matrix import ID, LABEL, feature_columns, train_matrix
from antecede.plans import features as X
from antecede.plans.roles import GAME
from antecede.session import stored
from logs import by_session, log_of, row, start
from test_features import CLIP, click, submit



@pytest.fixture(scope="module")
def log(spark):
    return log_of(spark, [
        row("u", "g1", 1, code=2000, count=1), click("u", "g1", 2, 3, 4), click("u", "g1", 3, 9, 4),
        row("u", "c1", 5, "Rulers", "Clip", 2000, 1, CLIP), row("u", "c2", 9, "Rulers", "Clip", 2000, 1, "z"),
        row("u", "g2", 10, count=4, event="cfbd47c8"), row("u", "g2", 11, event="19967db1"),
        start("u", "a1", 20), submit("u", "a1", 21, '{"correct":true}'),
        start("u", "a2", 40), submit("u", "a2", 41, '{"correct":false}'),
        start("v", "a3", 4), submit("v", "a3", 5, '{"correct":true}'), start("u", "open", 60),
    ])


@pytest.fixture(scope="module")
def matrices(spark, log):
    roles = GAME.observed(log)
    labels = log.where("event_code = 4100").select("installation_id", "world2").distinct()
    eligible = eligible_train(log, labels, roles)
    train = train_matrix(eligible, roles)
    return roles, eligible, train, M.test_matrix(log, roles, train.columns, maxima=train)


def test_one_row_per_anchor_with_every_feature(matrices):
    roles, eligible, train, _ = matrices
    assert train.columns == [*ID, *feature_columns(roles), LABEL]
    got = by_session(train)
    assert sorted(got) == ["a1", "a2", "a3"]
    assert [got[s][LABEL] for s in ("a1", "a2", "a3")] == [3, 0, 3]
    assert all(v == 0 for k, v in got["a3"].items() if k not in ("installation_id", LABEL, "x7__chow_time"))
    assert got["a2"]["count"] == 1.0 and got["a1"]["x10__chow_time"] == 1.0 and got["a1"]["x6__rulers"] == 1.0


def test_the_matrix_agrees_with_each_feature_alone(matrices):
    roles, eligible, train, _ = matrices
    wide = by_session(train)
    for feature in (X.x1, X.x1_running, X.x2, X.x2_running, X.x3, X.x4, X.x6, X.x7, X.x8, X.x9, X.x10, X.x11, X.x12, X.x13, X.x14):
        for session, values in by_session(feature(eligible, roles)).items():
            for name, value in values.items():
                assert wide[session][name] == pytest.approx(value or 0.0), (feature.__name__, session, name)


def test_the_test_matrix_has_one_row_per_user_in_train_order(matrices):
    _, _, train, test = matrices
    assert test.columns == [c for c in train.columns if c != LABEL]
    assert sorted(r["game_session"] for r in test.collect()) == ["a3", "open"]


def test_the_log_is_read_once(spark, log, matrices, tmp_path, monkeypatch):
    roles, eligible, train, _ = matrices
    path = f"{tmp_path}/log"
    eligible.write.parquet(path)
    plans = []
    monkeypatch.setattr(tape, "stored", lambda df, by: plans.append(df) or stored(df, by))
    again = train_matrix(spark.read.parquet(path), roles)
    assert len(plans) == 1 and plans[0]._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert not [f for f in again.inputFiles() if path in f]
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    reading = [executions.apply(i).physicalPlanDescription() for i in range(executions.size())]
    assert sum(path in p and "InsertIntoHadoopFs" in p and "Generate" in p for p in reading) == 1  # the tape
    assert sum(path in p for p in reading) == 2  # and the write of the log itself
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, train.collect()))


def test_parts_of_the_tape_hold_what_their_features_read(log):
    parts = tape.log_tape(log, GAME.observed(log))
    assert parts.part("clip").count() == log.count()
    assert parts.part("click").select("x", "y").collect() == [(3, 4), (9, 4)]
    assert parts.part("assessment").where("right").count() == 2
    assert "PartitionFilters: [isnotnull(part" in parts.part("help")._jdf.queryExecution().executedPlan().toString()
