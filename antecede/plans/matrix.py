"""One wide row per anchor: all features side by side.

The matrix functions read the eligible log once, into a tape (``plans.tape``); all features come from that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import slugs
from antecede.operators.frames import align_to, fill_max
from antecede.operators.joins import keep_matching
from antecede.operators.prior import prior_table
from antecede.operators.timeline import HOUR, latest_per_key
from antecede.plans import features as X
from antecede.plans.eligibility import anchors
from antecede.plans.roles import Roles
from antecede.plans.tape import Tape, log_tape
from antecede.session import materialize

ID = ("installation_id", "game_session")
ANCHOR = ("installation_id", "world2", "game_session", "ts", "title")
LABEL = "accuracy_group"


def assemble(base: DataFrame, features: Sequence[DataFrame], on: str = "game_session") -> DataFrame:
    """Left-joins each feature table, one row per session, to ``base``."""
    out = base
    for feature in features:
        out = out.join(feature, on, "left")
    return out


def feature_columns(roles: Roles) -> list[str]:
    """Names of the matrix columns, in order, known before any job runs."""
    titles, codes = slugs(roles.titles), slugs(roles.codes)
    return [
        *[f"x1_{k}__{g}" for k in ("cnt", "mean", "std") for g in titles],
        *[f"x2_{k}__{g}" for k in ("cnt", "mean", "std") for g in codes],
        *[f"x3_cnt__{g}" for g in slugs(roles.title_codes)],
        *[f"x4_{k}__{g}" for g in titles for k in ("max", "mean", "std")],
        *[f"x6__{g}" for g in slugs(roles.clip_rules)],
        *[f"x7__{g}" for g in slugs(roles.first_game.values())],
        *[f"x8__{g}" for g in slugs(roles.first_activity.values())],
        "count",
        *[f"x10__{g}" for g in slugs(roles.help_game.values())],
        *[f"x11__{g}" for g in slugs(roles.help_activity.values())],
        "hour",
        "dayofweek",
        *[f"x13_{a}__{g}" for a in ("x", "y") for g in titles],
        "seconds",
    ]


def _prior_features(tape: Tape, roles: Roles, maxima: DataFrame | None, slot_seconds: int) -> DataFrame:
    """X1 to X4, X6 to X8, X10, X11, X13 and X14 from one shared prior table, for each distinct anchor (``_anchor``)."""
    ids = (*roles.first_game, *roles.first_activity)
    state = prior_table(
        anchors(tape.part("assessment"), roles),
        [
            X.activity(tape.part("activity"), roles, ["x1", "x2", "x3", "x14"]),
            *X.last_rows(tape.part("activity"), roles),
            X.clip_scores(X.x6_clips(tape.part("clip"), roles, slot_seconds=slot_seconds), roles),
            X.first_events(tape.part("first"), ids),
            X.helps(tape.part("help"), "x10", tuple(roles.help_game)),
            X.helps(tape.part("help"), "x11", tuple(roles.help_activity)),
            X.click_spreads(tape.part("click"), roles),
        ],
        slot_seconds=slot_seconds,
    )
    state = materialize(state)
    groups = {"x1": slugs(roles.titles), "x2": slugs(roles.codes)}
    state = X.running(state, {"x1": ("x1_all_n > 0", groups["x1"]), "x2": ("act_all_n > 0", groups["x2"])}, slot_seconds)
    first = [
        *X.first_columns("x7", roles.first_game),
        *X.first_columns("x8", roles.first_activity),
    ]
    out = state.selectExpr(
        f"struct({', '.join(ANCHOR)}) AS _anchor",
        *X.x1_columns(roles),
        *[f"x1_{k}__{g}" for k in ("mean", "std") for g in groups["x1"]],
        *X.x2_columns(roles),
        *[f"x2_{k}__{g}" for k in ("mean", "std") for g in groups["x2"]],
        *X.x3_columns(roles),
        *X.x4_columns(roles),
        *X.x6_columns(roles),
        *first,
        *X.help_columns("x10", roles.help_game),
        *X.help_columns("x11", roles.help_activity),
        *X.x13_columns(roles),
        X.x14_column(state),
    )
    filled = [
        *[f"x7__{g}" for g in slugs(roles.first_game.values())],
        *[f"x8__{g}" for g in slugs(roles.first_activity.values())],
    ]
    # A table: the largest values are looked up beside it.
    return fill_max(materialize(out) if maxima is None else out, filled, maxima)


def _base(tape: Tape, roles: Roles, maxima: DataFrame | None, slot_seconds: int) -> DataFrame:
    """Every anchor row of the log, with its prior features where it has any."""
    rows = anchors(tape.part("assessment"), roles).select(*ID, F.struct(*ANCHOR).alias("_anchor"))
    return rows.join(_prior_features(tape, roles, maxima, slot_seconds), "_anchor", "left").drop("_anchor")


def _beside(tape: Tape, roles: Roles, slot_seconds: int) -> list[DataFrame]:
    return [X.x9(tape.part("attempt"), roles, slot_seconds=slot_seconds), X.x12(tape.part("assessment"), roles)]


def _finish(df: DataFrame, roles: Roles, extra: Sequence[str] = ()) -> DataFrame:
    return df.selectExpr(
        *ID,
        *[f"coalesce(CAST({c} AS DOUBLE), 0D) AS {c}" for c in feature_columns(roles)],
        *[f"coalesce({c}, 0) AS {c}" for c in extra],
    )


def train_matrix(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    """Every anchor of the eligible training log, with its accuracy group.

    Absent features are 0; an anchor without user, world or title stays.  Row order carries no meaning; sort at the sink.
    """
    tape = log_tape(df, roles)
    label = X.x5(tape.part("assessment"), roles).select("game_session", LABEL)
    wide = assemble(_base(tape, roles, None, slot_seconds), [label, *_beside(tape, roles, slot_seconds)])
    return _finish(wide, roles, extra=[LABEL])


def test_matrix(
    df: DataFrame, roles: Roles, columns: Sequence[str] | None = None, maxima: DataFrame | None = None,
    slot_seconds: int = HOUR,
) -> DataFrame:
    """The last anchor of each user of the eligible test log.

    ``columns`` are the training matrix's, whose order the result takes;
    columns the test log cannot have are 0.  ``maxima`` is a frame to take the
    X7/X8 fill values from, the training matrix for instance; by default they
    come from the test log itself.
    """
    tape = log_tape(df, roles)
    wide = assemble(_base(tape, roles, maxima, slot_seconds), _beside(tape, roles, slot_seconds))
    last = latest_per_key(anchors(tape.part("assessment"), roles), ["installation_id"], ["ts", "game_session"], ["game_session"])
    picked = keep_matching(_finish(wide, roles), last, list(ID))
    wanted = [c for c in (columns or picked.columns) if c != LABEL]
    return align_to(picked, wanted)
