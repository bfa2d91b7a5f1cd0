"""Hand-worked answers for the features, on the game's own roles."""

import math
from dataclasses import replace

import pytest

from antecede.plans import features as X
from antecede.plans.eligibility import eligible_test, eligible_train, last_assessment
from antecede.plans.roles import GAME
from logs import by_session, log_of, row, start

CART = "Cart Balancer (Assessment)"
BIRD = "Bird Measurer (Assessment)"
ROLES = replace(
    GAME,
    titles=("Chow Time", "Rulers"),
    codes=(2000, 4020),
    title_codes=("Chow Time_2000", "Chow Time_4020", "Rulers_2000", "Rulers_4020"),
)


def test_x1_counts_starts_strictly_before_in_the_same_world(spark):
    log = log_of(spark, [
        row("u", "g1", 10, code=2000), row("u", "g1", 11), row("u", "g2", 100, code=2000),
        row("u", "g3", 5, code=2000, world="OTHER"), row("v", "g4", 5, code=2000),
        row("u", "g5", 20, "Rulers", "Clip", 2000), start("u", "a1", 100), start("u", "a2", 101), start("w", "a3", 500),
    ])
    assert by_session(X.x1(log, ROLES)) == {
        "a1": {"x1_cnt__chow_time": 1, "x1_cnt__rulers": 1},
        "a2": {"x1_cnt__chow_time": 2, "x1_cnt__rulers": 1},
    }


def test_x1_running_counts_zeros_but_not_anchors_without_history(spark):
    log = log_of(spark, [
        start("u", "a0", 1), row("u", "g1", 10, code=2000), start("u", "a1", 20),
        row("u", "g2", 30, "Rulers", "Clip", 2000), row("u", "g3", 31, code=2000), start("u", "a2", 40),
        start("u", "b1", 41, title=BIRD),
    ])
    got = by_session(X.x1_running(log, ROLES))
    assert sorted(got) == ["a1", "a2", "b1"]
    assert got["a1"] == {"x1_mean__chow_time": 1.0, "x1_mean__rulers": 0.0, "x1_std__chow_time": 0.0, "x1_std__rulers": 0.0}
    assert got["a2"]["x1_mean__chow_time"] == 1.5 and got["a2"]["x1_mean__rulers"] == 0.5
    assert got["a2"]["x1_std__chow_time"] == pytest.approx(math.sqrt(0.5))
    assert got["b1"]["x1_mean__chow_time"] == 2.0 and got["b1"]["x1_std__rulers"] == 0.0


def test_x2_and_x3_count_every_event(spark):
    log = log_of(spark, [
        row("u", "g1", 1, code=2000), row("u", "g1", 2), row("u", "g1", 2), row("u", "c", 3, "Rulers", "Clip", 2000),
        row("u", "a", 4, CART, "Assessment", 4020), start("u", "a1", 9),
    ])
    assert by_session(X.x2(log, ROLES)) == {"a1": {"x2_cnt__2000": 2, "x2_cnt__4020": 2}}
    assert by_session(X.x3(log, ROLES))["a1"] == {
        "x3_cnt__chow_time_2000": 1, "x3_cnt__chow_time_4020": 2, "x3_cnt__rulers_2000": 1, "x3_cnt__rulers_4020": 0,
    }


def test_x4_uses_last_rows_that_precede_the_anchor(spark):
    log = log_of(spark, [
        row("u", "g1", 1, count=1), row("u", "g1", 2, count=5),
        row("u", "g2", 3, count=9), row("u", "g3", 4, count=2), row("u", "g3", 50, count=30), start("u", "a1", 20),
    ])
    (got,) = by_session(X.x4(log, ROLES)).values()
    assert (got["x4_max__chow_time"], got["x4_mean__chow_time"]) == (9, 7.0)
    assert got["x4_std__chow_time"] == pytest.approx(math.sqrt(8)) and got["x4_std__rulers"] == 0.0


def test_x4_keeps_tied_last_rows(spark):
    log = log_of(spark, [row("u", "g1", 1, count=5), row("u", "g1", 2, count=5), row("u", "g2", 3, count=2), start("u", "a", 9)])
    (got,) = by_session(X.x4(log, ROLES)).values()
    assert got["x4_mean__chow_time"] == 4.0


def test_x4_spread_of_large_counts_does_not_cancel(spark):
    log = log_of(spark, [row("u", f"g{i}", i, count=100_000_000 + i) for i in range(3)] + [start("u", "a", 9)])
    (got,) = by_session(X.x4(log, ROLES)).values()
    assert got["x4_std__chow_time"] == pytest.approx(1.0) and got["x4_max__chow_time"] == 100_000_002


def submit(user, session, second, answer, title=CART, code=4100):
    return row(user, session, second, title, "Assessment", code, 5, "s", "W", answer)


def test_x5_one_row_per_session_and_exact_text(spark):
    yes, no, loud = '{"correct":true}', '{"correct":false}', '{"correct":TRUE}'
    log = log_of(spark, [
        submit("u", "once", 1, yes), submit("u", "late", 2, no), submit("u", "late", 3, yes),
        submit("u", "twice", 4, yes), submit("u", "twice", 5, yes), submit("u", "loud", 6, loud),
        submit("u", "third", 7, no), submit("u", "third", 8, no), submit("u", "third", 9, yes),
        submit("u", "bird", 10, yes, BIRD, 4110), submit("u", "birdx", 11, yes, BIRD, 4100), submit("u", "none", 12, "{}"),
    ])
    got = {s: (r["correct"], r["try"], r["accuracy_group"]) for s, r in by_session(X.x5(log, ROLES)).items()}
    assert got == {
        "once": (1, 1, 3), "late": (1, 2, 2), "twice": (1, 2, 2), "loud": (0, 1, 0), "third": (1, 3, 1), "bird": (1, 1, 3),
        "none": (0, 1, 0),
    }


CLIP = "27253bdc"


def test_x6_credits_the_next_row_and_needs_its_title_to_be_a_clip(spark):
    log = log_of(spark, [
        row("u", "c1", 0, "Rulers", "Clip", 2000, 1, CLIP), row("u", "c2", 20, "Treasure Map", "Clip", 2000, 1, CLIP),
        row("u", "g1", 500, "Chow Time"), row("u", "c3", 600, "Rulers", "Clip", 2000, 1, CLIP),
        row("v", "c4", 601, "Rulers", "Clip", 2000, 1, "other"), start("u", "a1", 900), start("v", "a2", 900),
    ])
    clips = [(r["game_session"], r["title"], r["duration"], r["score"]) for r in X.x6_clips(log, ROLES).collect()]
    assert clips == [("c2", "Treasure Map", 20.0, 2)]
    own = {(r["game_session"], r["duration"], r["score"]) for r in X.x6_clips(log, ROLES, "self").collect()}
    assert own == {("c1", 20.0, 1), ("c2", 480.0, 0), ("c3", 300.0, 0)}
    got = by_session(X.x6(log, ROLES))
    assert got["a1"]["x6__treasure_map"] == 2.0 and got["a1"]["x6__rulers"] == 0.0
    assert set(got["a2"].values()) == {0.0}
    with pytest.raises(ValueError):
        X.x6_clips(log, ROLES, "both")


def test_x6_leaves_out_users_whose_clips_all_come_later(spark):
    log = log_of(spark, [
        start("u", "a1", 1), row("u", "c1", 5, "Rulers", "Clip", 2000, 1, CLIP), row("u", "c2", 9, "Rulers", "Clip", 2000, 1, CLIP),
    ])
    assert by_session(X.x6(log, ROLES)) == {}


def test_x6_ties_in_time_follow_the_event_count(spark):
    log = log_of(spark, [
        row("u", "c", 5, "Rulers", "Clip", 2000, 2, "z"), row("u", "c", 5, "Rulers", "Clip", 2000, 1, CLIP), row("u", "c", 9, "Rulers", "Clip", 2000, 3, "z"),
    ])
    assert [r["duration"] for r in X.x6_clips(log, ROLES).collect()] == [0.0]


GAME_ID = "cfbd47c8"


def test_x7_never_before_and_only_later(spark):
    log = log_of(spark, [
        row("u", "g1", 1, count=8, event=GAME_ID), row("u", "g1", 2, count=6, event=GAME_ID), row("u", "g2", 3, count=3, event=GAME_ID),
        start("u", "before", 10), start("v", "never", 10), start("w", "later", 1), row("w", "g3", 5, count=90, event=GAME_ID),
    ])
    got = by_session(X.x7(log, ROLES))
    assert {s: r["x7__chow_time"] for s, r in got.items()} == {"before": 4.5, "never": 0.0, "later": 4.5}
    assert got["before"]["x7__dino_drink"] == 0.0


def test_x7_looks_at_the_whole_session_unless_strict(spark):
    log = log_of(spark, [
        row("u", "g1", 1, count=8, event=GAME_ID), start("u", "a1", 5), row("u", "g1", 9, count=2, event=GAME_ID),
        start("u", "a2", 10), row("v", "g2", 70, count=5, event=GAME_ID), start("v", "a3", 60),
    ])
    loose = {s: r["x7__chow_time"] for s, r in by_session(X.x7(log, ROLES)).items()}
    strict = {s: r["x7__chow_time"] for s, r in by_session(X.x7(log, ROLES, strict=True)).items()}
    assert loose == {"a1": 2.0, "a2": 2.0, "a3": 2.0}
    assert strict == {"a1": 8.0, "a2": 2.0, "a3": 8.0}


def test_x8_may_take_its_fill_value_from_another_result(spark):
    fire = "02a42007"
    train = log_of(spark, [row("u", "g", 1, count=7, event=fire), start("u", "a", 5)])
    test = log_of(spark, [start("u", "a", 1), row("u", "g", 5, count=3, event=fire)])
    assert by_session(X.x8(test, ROLES))["a"]["x8__fireworks"] is None
    assert by_session(X.x8(test, ROLES, maxima=X.x8(train, ROLES)))["a"]["x8__fireworks"] == 7.0


def test_x9_numbers_per_title_or_by_position(spark):
    log = log_of(spark, [
        start("u", f"s{i}", i, title, event=event)
        for i, (title, event) in enumerate([(CART, "7ad3efc6"), (BIRD, "f56e0afc")] * 2 + [(CART, "7ad3efc6")])
    ])
    assert [r["count"] for _, r in sorted(by_session(X.x9(log, ROLES)).items())] == [0, 0, 1, 1, 2]
    assert [r["count"] for _, r in sorted(by_session(X.x9(log, ROLES, by_position=True)).items())] == [0, 1, 2, 0, 1]


def test_x10_shows_the_session_total_under_each_seen_id(spark):
    camel, chow, star = "05ad839b", "19967db1", "6043a2b4"
    log = log_of(spark, [
        row("u", "g", 1, event=camel), row("u", "g", 2, event=camel), row("u", "g", 3, event=chow),
        start("u", "a1", 5), row("u", "g", 9, event=star), start("v", "a2", 5), start("w", "a3", 1), row("w", "g2", 4, event=chow),
    ])
    got = by_session(X.x10(log, ROLES))
    assert sorted(got) == ["a1", "a2"]
    assert (got["a1"]["x10__happy_camel"], got["a1"]["x10__chow_time"], got["a1"]["x10__all_star_sorting"]) == (3, 3, 0)
    per = by_session(X.x10(log, ROLES, per_event=True))["a1"]
    assert (per["x10__happy_camel"], per["x10__chow_time"]) == (2, 1)
    assert set(got["a2"].values()) == {0}


def test_x11_names_follow_the_ids(spark):
    log = log_of(spark, [row("u", "g", 1, event="e7e44842"), start("u", "a", 5)])
    got = by_session(X.x11(log, ROLES))["a"]
    assert got["x11__watering_hole"] == 1 and sum(got.values()) == 1


def test_x12_takes_the_first_event_of_an_assessment(spark):
    log = log_of(spark, [start("u", "a", 3 * 3600 + 5), row("u", "a", 9 * 3600, CART, "Assessment", 4020, 2), row("u", "g", 1, count=1)])
    assert by_session(X.x12(log, ROLES)) == {"a": {"hour": 3, "dayofweek": 0}}


def click(user, session, second, x, y, title="Chow Time"):
    return row(user, session, second, title, data=f'{{"x":{x},"y":{y}}}')


def test_x13_spread_of_spreads_counts_clicks_after_the_anchor(spark):
    log = log_of(spark, [
        click("u", "g1", 1, 0, 0), click("u", "g1", 2, 4, 2), click("u", "g2", 3, 10, 5), click("u", "g2", 90, 20, 5),
        start("u", "a1", 50), click("u", "g3", 60, 1, 1), start("u", "a2", 70), start("v", "a3", 70),
    ])
    got = by_session(X.x13(log, ROLES))
    assert sorted(got) == ["a1", "a2"]
    assert got["a1"]["x13_x__chow_time"] == pytest.approx(1.5)  # spreads 2 and 5
    assert got["a1"]["x13_y__chow_time"] == pytest.approx(0.5)  # spreads 1 and 0
    assert got["a2"]["x13_x__chow_time"] == pytest.approx(math.sqrt((4 + 25 + 0) / 3 - (7 / 3) ** 2))
    assert got["a1"]["x13_x__rulers"] == 0.0
    strict = by_session(X.x13(log, ROLES, strict=True))
    assert strict["a1"]["x13_x__chow_time"] == pytest.approx(1.0)  # spreads 2 and 0
    assert strict["a2"]["x13_x__chow_time"] == pytest.approx(math.sqrt(4 / 3 - (2 / 3) ** 2))


def test_x13_equal_spreads_do_not_cancel_into_noise(spark):
    # A session's own spread may differ in its last bit with the order of its clicks.
    log = log_of(spark, [click("u", f"g{i}", i * 10 + j, j * j * 37, j) for i in range(7) for j in range(3)] + [start("u", "a", 900)])
    assert by_session(X.x13(log, ROLES))["a"]["x13_x__chow_time"] < 1e-12


def test_x14_gap_to_the_last_activity(spark):
    log = log_of(spark, [row("u", "g", 1), row("u", "g", 4), row("u", "g", 10), row("u", "a0", 8, CART, "Assessment"), start("u", "a1", 10), start("v", "a2", 5)])
    assert by_session(X.x14(log, ROLES)) == {"a1": {"seconds": 6.0}}


def test_eligible_train_keeps_labelled_worlds_and_submitted_assessments(spark):
    log = log_of(spark, [
        row("u", "g1", 1), row("u", "g2", 2, world="X"), row("v", "g3", 1),
        start("u", "done", 5), submit("u", "done", 6, "{}"), start("u", "open", 7),
        start("u", "bird", 8, BIRD), submit("u", "bird", 9, "{}", BIRD, 4100),
    ])
    labels = spark.createDataFrame([("u", "W"), ("u", "W")], "installation_id string, world2 string")
    got = [r["game_session"] for r in eligible_train(log, labels, ROLES).collect()]
    assert sorted(got) == ["done", "done", "g1"]


def test_eligible_test_keeps_the_world_of_the_last_assessment(spark):
    log = log_of(spark, [
        row("u", "g1", 1), row("u", "g2", 2, world="X"), start("u", "a1", 5, world="X"), start("u", "a2", 9), row("u", "g4", 99, world="X"), row("v", "g3", 1),
    ])
    assert sorted(r["game_session"] for r in eligible_test(log, ROLES).collect()) == ["a2", "g1"]
    (last,) = last_assessment(log, ROLES).collect()
    assert (last["game_session"], last["world2"]) == ("a2", "W")


@pytest.mark.parametrize("name", ["x1", "x1_running", "x4", "x6", "x7", "x9", "x10", "x13", "x14", "x5", "x12"])
def test_an_empty_log_gives_no_rows(spark, name):
    assert getattr(X, name)(log_of(spark, []), ROLES).collect() == []


def test_observed_roles_list_what_the_log_has(spark):
    log = log_of(spark, [row("u", "g", 1), row("u", "g", 2, code=2000), row("u", "c", 3, "Rulers", "Clip", 2000), start("u", "a", 4)])
    got = GAME.observed(log)
    assert got.titles == ("Chow Time", "Rulers") and got.codes == (2000, 4020)
    assert got.title_codes == ("Chow Time_2000", "Chow Time_4020", "Rulers_2000")
