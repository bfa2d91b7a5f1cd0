"""The features X1 to X14.

Each prior feature is a family of rows (what counts), cells (how it is grouped)
and output columns computed from the state at the anchor.  The functions
``x1`` ... ``x14`` run one feature alone; the matrix runs all of them over one
shared prior table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import (
    accuracy_group,
    bucket_by_rule,
    hour_dow,
    micros,
    ratio,
    slugs,
)
from antecede.operators.frames import fill_max, session_last_rows
from antecede.operators.joins import spread_join
from antecede.operators.prior import KEYS, Cell, Family, prior_table
from antecede.operators.timeline import (
    HOUR,
    AT,
    SLOT,
    earliest_per_key,
    join_slots,
    numbered,
    previous_row,
    running_sums,
    with_place,
    with_slot,
)
from antecede.plans.eligibility import anchors, row_order
from antecede.plans.roles import Roles
from antecede.plans.tape import parsed
from antecede.session import materialize

ANCHOR = ("installation_id", "game_session")


# ---- families -----------------------------------------------------------------


def activity(df: DataFrame, roles: Roles, cells: Sequence[str]) -> Family:
    """All rows outside assessments: feeds X1, X2, X3 and X14 in one pass.

    X1 to X3 count event ids, so a row without one is prior activity but adds to no count.
    """
    title_code = F.concat("title", F.lit("_"), "event_code")
    started = F.col("event_code") == str(roles.start_code)
    named = F.col("named") == "true"
    known = {
        "x1": (Cell("x1", ("n",), F.col("title"), roles.titles, when=started & named), Cell("x1_all", when=started)),
        "x2": (Cell("x2", ("n",), F.col("event_code"), tuple(str(c) for c in roles.codes), when=named),),
        "x3": (Cell("x3", ("n",), title_code, roles.title_codes, when=named),),
        "x14": (Cell("x14", ("max",)),),
    }
    chosen = tuple(cell for name in cells for cell in known[name])
    if {"x2", "x3"} & set(cells):
        chosen += (Cell("act_all"),)
    users = (("title", {"x1", "x3"}), ("event_code", {"x1", "x2", "x3"}), ("named", {"x1", "x2", "x3"}))
    by = tuple(c for c, who in users if who & set(cells))
    rows = df.where(~roles.is_assessment())
    if "named" in by:
        rows = rows.withColumn("named", F.col("event_id").isNotNull())
    if set(cells) == {"x1"}:
        rows = rows.where(F.col("event_code") == roles.start_code)
    return Family("activity", rows.select(*KEYS, "ts", *by), chosen, by=by, value=F.col("_t"))


def last_rows(df: DataFrame, roles: Roles) -> list[Family]:
    """The final rows of sessions outside assessments (X4), as they are and centred.

    Counts may be large and close to each other, so the variance comes from their distance to a whole number near the
    average of their (user, world, title): squares of those do not cancel.
    """
    needed = df.where(~roles.is_assessment()).select(*KEYS, "ts", "title", "game_session", "event_count")
    rows = session_last_rows(needed).select(*KEYS, "ts", "title", "event_count")
    group = [*KEYS, "title"]
    known = materialize(rows.where(" AND ".join(f"{c} IS NOT NULL" for c in group)))
    centers = known.groupBy(*group).agg(F.floor(F.avg("event_count")).alias("_center"))
    centred = spread_join(known, centers, group, "inner", ["ts"])
    return [
        Family(
            "last_rows", rows, (Cell("x4", ("c", "s", "max"), F.col("title"), roles.titles), Cell("x4_all")), by=("title",),
            value=F.col("event_count"), dense=False,
        ),
        Family(
            "last_rows_centred", centred.select(*KEYS, "ts", "title", (F.col("event_count") - F.col("_center")).alias("distance")),
            (Cell("x4d", ("s", "q"), F.col("title"), roles.titles),), by=("title",), value=F.col("distance"), dense=False,
        ),
    ]


def clip_scores(clips: DataFrame, roles: Roles) -> Family:
    """Scored clips (X6)."""
    return Family(
        "clips",
        clips.select(*KEYS, "ts", "title", "score"),
        (Cell("x6", ("c", "s"), F.col("title"), tuple(roles.clip_rules)), Cell("x6_all", ("n", "any"))),
        by=("title",),
        value=F.col("score"),
        dense=False,
    )


def first_events(df: DataFrame, ids: Sequence[str], strict: bool = False, slot_seconds: int = HOUR) -> Family:
    """Per session and wanted event id, when and at which count it first came (X7, X8).

    The smallest count is that of the whole session, even if it lies after the
    anchor.  ``strict`` looks at earlier rows only: each improvement of a
    session's smallest count then arrives as a row of its own.
    """
    group = [*KEYS, "game_session", "title", "event_id"]
    rows = df.where(F.col("event_id").isin(list(ids)))
    if strict:
        rows = _first_event_changes(rows, group, slot_seconds)
        stats, sessions = ("s",), Cell("first_sessions", ("n", "any"), F.col("event_id"), tuple(ids), when=F.col("opens") == "1")
        cells = (Cell("first", stats, F.col("event_id"), tuple(ids)), sessions)
        return Family("first", rows, cells, by=("event_id", "opens"), value=F.col("delta"), dense=False)
    firsts = rows.groupBy(*group).agg(F.min("ts").alias("ts"), F.min("event_count").alias("event_count"))
    return Family(
        "first",
        firsts.select(*KEYS, "ts", "event_id", "event_count"),
        (Cell("first", ("c", "s", "any"), F.col("event_id"), tuple(ids)),),
        by=("event_id",),
        value=F.col("event_count"),
        dense=False,
    )


def _first_event_changes(rows: DataFrame, group: list[str], slot_seconds: int) -> DataFrame:
    """One row per instant at which a session's smallest count changes, with the change."""
    at = rows.groupBy(*group, "ts").agg(F.min("event_count").alias("low"))
    slotted = with_place(with_slot(at.where("low IS NOT NULL"), seconds=slot_seconds), group)
    here = Window.partitionBy(AT).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    local = slotted.withColumn("_low_here", F.min("low").over(here))
    per_slot = slotted.groupBy(*group, SLOT).agg(F.min("low").alias("_slot_low"))
    earlier = Window.partitionBy(*group).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    before = per_slot.select(*group, SLOT, F.min("_slot_low").over(earlier).alias("_low_before"))
    known = join_slots(local, before, group).withColumn("was", F.least("_low_here", "_low_before"))
    return known.where(F.col("was").isNull() | (F.col("low") < F.col("was"))).select(
        *KEYS, "ts", "event_id",
        F.when(F.col("was").isNull(), "1").otherwise("0").alias("opens"),
        (F.col("low") - F.coalesce("was", F.lit(0))).cast("double").alias("delta"),
    )


def helps(df: DataFrame, name: str, ids: Sequence[str]) -> Family:
    """Clicks on help (X10, X11)."""
    return Family(
        name,
        df.where(F.col("event_id").isin(list(ids))).select(*KEYS, "ts", "event_id"),
        (Cell(name, ("n",), F.col("event_id"), tuple(ids)), Cell(f"{name}_all", ("n", "any"))),
        by=("event_id",),
    )


def clicks(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows outside assessments with whole-number coordinates."""
    known = df if "clicked" in df.columns else parsed(df, roles)
    return known.where(~roles.is_assessment() & F.col("clicked")).select(*dict.fromkeys([*KEYS, "title", *row_order(df)]), "x", "y")


def click_spreads(df: DataFrame, roles: Roles) -> Family:
    """Per session, the spread of its clicks along x and y (X13).

    The session is placed at its first click, but its spread is that of all its
    clicks, later ones included.

    The variance of a prefix is taken from sums of the values less the first
    value of their (user, world, title, axis).  That reference lies in every
    prefix, so equal values give exactly 0 and nothing cancels.
    """
    found = clicks(df, roles)
    first = earliest_per_key(found, ["game_session"], row_order(df), [*KEYS, "title", "ts"])
    spreads = found.groupBy("game_session").agg(F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y"))
    same = F.col("f.game_session").eqNullSafe(F.col("s.game_session"))
    sessions = first.alias("f").join(spreads.alias("s"), same).select("f.*", "x", "y")
    axes = F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("spread")),
        F.struct(F.lit("y").alias("axis"), F.col("y").alias("spread")),
    ))
    long = sessions.select("game_session", *KEYS, "title", "ts", axes.alias("_a")).select(
        "game_session", *KEYS, "title", "ts", "_a.*"
    )
    group = [*KEYS, "title", "axis"]
    long = long.where(" AND ".join(f"{c} IS NOT NULL" for c in group))
    reference = earliest_per_key(long, group, ["ts", "game_session"], ["spread"]).withColumnRenamed("spread", "_reference")
    shifted = spread_join(long, reference, group, "inner", ["game_session"])
    stats = ("c", "s", "q")
    return Family(
        "clicks",
        shifted.select(*KEYS, "ts", "title", "axis", (F.col("spread") - F.col("_reference")).alias("spread")),
        (
            Cell("x13x", stats, F.col("title"), roles.titles, when=F.col("axis") == "x"),
            Cell("x13y", stats, F.col("title"), roles.titles, when=F.col("axis") == "y"),
            Cell("x13_all"),
        ),
        by=("title", "axis"),
        value=F.col("spread"),
        dense=False,
    )


def click_spread_changes(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> list[Family]:
    """X13 over earlier clicks only: each click reports how it changed its session's spread.

    Summing the changes up to an anchor gives every session's spread as it then
    stood, without looking at a session twice.
    """
    order = row_order(df)
    sums = {"_n": "1D"}
    for a in ("x", "y"):
        sums |= {f"_s{a}": f"CAST({a} AS DOUBLE)", f"_q{a}": f"CAST({a} AS DOUBLE) * {a}"}
    known = running_sums(with_slot(clicks(df, roles), seconds=slot_seconds), ["game_session"], order, sums)
    axes = ", ".join(
        f"named_struct('axis', '{a}', 'now', {_std('_n', f'_s{a}', f'_q{a}', sample=False)}, "
        f"'was', {_std('(_n - 1)', f'(_s{a} - {a})', f'(_q{a} - CAST({a} AS DOUBLE) * {a})', sample=False)})"
        for a in ("x", "y")
    )
    changes = known.selectExpr(*KEYS, "ts", "title", "CAST(_n = 1 AS STRING) AS opens", f"inline(array({axes}))")
    by = ("title", "axis", "opens")
    families = []
    for name, stat, value in (("spread", "", "now - was"), ("square", "_sq", "now * now - was * was")):
        cells = []
        for a in ("x", "y"):
            own = F.col("axis") == a
            cells.append(Cell(f"x13{a}{stat}", ("s",), F.col("title"), roles.titles, when=own))
            if name == "spread":
                opened = own & (F.col("opens") == "true")
                cells.append(Cell(f"x13{a}_open", ("n",), F.col("title"), roles.titles, when=opened))
        if name == "spread":
            cells.append(Cell("x13_all"))
        rows = changes.selectExpr(*KEYS, "ts", *by, f"{value} AS change")
        families.append(Family(name, rows, tuple(cells), by=by, value=F.col("change")))
    return families


# ---- from state to output columns ------------------------------------------------


def _count(state: str, name: str) -> str:
    return f"CAST({state} AS BIGINT) AS {name}"


def _mean(prefix: str, g: str) -> str:
    return f"try_divide({prefix}_s__{g}, {prefix}_c__{g})"


def _std(n: str, s: str, q: str, sample: bool) -> str:
    """0 up to one value; clamped because rounding may leave a negative trace."""
    free = f"({n} - 1)" if sample else n
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest(({n} * {q} - {s} * {s}) / ({n} * {free}), 0D)) ELSE 0D END"


def x1_columns(roles: Roles) -> list[str]:
    return [_count(f"x1_n__{g}", f"x1_cnt__{g}") for g in slugs(roles.titles)]


def x2_columns(roles: Roles) -> list[str]:
    return [_count(f"x2_n__{g}", f"x2_cnt__{g}") for g in slugs(roles.codes)]


def x3_columns(roles: Roles) -> list[str]:
    return [_count(f"x3_n__{g}", f"x3_cnt__{g}") for g in slugs(roles.title_codes)]


def x4_columns(roles: Roles) -> list[str]:
    out = []
    for g in slugs(roles.titles):
        n, s, q = f"x4_c__{g}", f"x4d_s__{g}", f"x4d_q__{g}"
        out += [
            f"CAST(coalesce(x4_max__{g}, 0D) AS BIGINT) AS x4_max__{g}",
            f"coalesce({_mean('x4', g)}, 0D) AS x4_mean__{g}",
            f"{_std(n, s, q, sample=True)} AS x4_std__{g}",
        ]
    return out


def x6_columns(roles: Roles) -> list[str]:
    return [f"coalesce({_mean('x6', g)}, 0D) AS x6__{g}" for g in slugs(roles.clip_rules)]


def first_columns(prefix: str, names: Mapping[str, str], strict: bool = False) -> list[str]:
    """0 if the event never came, its mean count if it came before, NULL if only after."""
    seen, count = ("first_sessions", "first_sessions_n") if strict else ("first", "first_c")
    return [
        f"CASE WHEN {seen}_any__{g} = 0 THEN 0D ELSE try_divide(first_s__{g}, {count}__{g}) END AS {prefix}__{name}"
        for g, name in zip(slugs(names), slugs(names.values()), strict=True)
    ]


def help_columns(prefix: str, names: Mapping[str, str], per_event: bool = False) -> list[str]:
    """The session's total help clicks under each id already seen; or each id's own."""
    out = []
    for g, name in zip(slugs(names), slugs(names.values()), strict=True):
        own = f"{prefix}_n__{g}"
        amount = own if per_event else f"CASE WHEN {own} > 0 THEN {prefix}_all_n ELSE 0D END"
        out.append(_count(amount, f"{prefix}__{name}"))
    return out


def x13_columns(roles: Roles, strict: bool = False) -> list[str]:
    n, q = ("_open_n", "_sq_s") if strict else ("_c", "_q")
    return [
        f"{_std(f'x13{a}{n}__{g}', f'x13{a}_s__{g}', f'x13{a}{q}__{g}', sample=False)} AS x13_{a}__{g}"
        for a in ("x", "y")
        for g in slugs(roles.titles)
    ]


def x14_column(df: DataFrame) -> str:
    """Seconds since the last activity; the instants are whole microseconds."""
    return f"({micros(df, 'ts')} - CAST(x14_max AS BIGINT)) / 1e6D AS seconds"


def running(state: DataFrame, plan: Mapping[str, tuple[str, Sequence[str]]], slot_seconds: int = HOUR) -> DataFrame:
    """Adds ``<prefix>_mean__g`` and ``<prefix>_std__g`` over a user's attempts so far.

    ``plan`` maps a prefix to the condition under which an anchor has prior rows
    and to its column groups.  Attempts are the anchors of one (user, assessment
    title).  Anchors without any prior row are no attempts: they neither count
    nor get a value.  Zeros of the others do count.

    Counts grow with history, so sums are taken of their distance from a whole number near the average of
    the attempts: squares of those do not cancel.
    """
    group = F.struct("installation_id", "title").alias("_group")
    values = [(seen, f"{prefix}_n__{g}") for prefix, (seen, groups) in plan.items() for g in groups]
    centers = state.groupBy(group).agg(
        F.struct(*[F.expr(f"coalesce(floor(avg(IF({seen}, {n}, NULL))), 0) AS {n}") for seen, n in values]).alias("_center")
    )
    centered = state.withColumn("_group", group).join(centers, "_group").drop("_group")
    sums, out = {}, []
    for prefix, (seen, groups) in plan.items():
        runs = f"_{prefix}_runs"
        sums[runs] = f"IF({seen}, 1D, 0D)"
        for g in groups:
            n, s, q = f"{prefix}_n__{g}", f"_{prefix}_s__{g}", f"_{prefix}_q__{g}"
            x = f"({n} - _center.{n})"
            sums[s], sums[q] = f"IF({seen}, {x}, 0D)", f"IF({seen}, {x} * {x}, 0D)"
            out.append(f"IF({seen}, _center.{n} + {s} / {runs}, NULL) AS {prefix}_mean__{g}")
            out.append(f"IF({seen}, {_std(runs, s, q, sample=True)}, NULL) AS {prefix}_std__{g}")
    slotted = with_slot(centered, seconds=slot_seconds)
    summed = running_sums(slotted, ["installation_id", "title"], ["ts", "game_session"], sums)
    return summed.selectExpr(*state.columns, *out)


# ---- one feature at a time -------------------------------------------------------


def x1(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    """Session starts per title before the anchor."""
    state = prior_table(anchors(df, roles), [activity(df, roles, ["x1"])], slot_seconds=slot_seconds)
    return state.where("x1_all_n > 0").selectExpr("game_session", *x1_columns(roles))


def x1_running(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    state = prior_table(anchors(df, roles), [activity(df, roles, ["x1"])], slot_seconds=slot_seconds).where("x1_all_n > 0")
    groups = slugs(roles.titles)
    out = running(state, {"x1": ("true", groups)}, slot_seconds)
    return out.select("game_session", *[f"x1_{k}__{g}" for k in ("mean", "std") for g in groups])


def x2(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    """Events per event code before the anchor."""
    state = prior_table(anchors(df, roles), [activity(df, roles, ["x2"])], slot_seconds=slot_seconds)
    return state.where("act_all_n > 0").selectExpr("game_session", *x2_columns(roles))


def x2_running(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    state = prior_table(anchors(df, roles), [activity(df, roles, ["x2"])], slot_seconds=slot_seconds).where("act_all_n > 0")
    groups = slugs(roles.codes)
    out = running(state, {"x2": ("true", groups)}, slot_seconds)
    return out.select("game_session", *[f"x2_{k}__{g}" for k in ("mean", "std") for g in groups])


def x3(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    """Events per title and event code before the anchor."""
    state = prior_table(anchors(df, roles), [activity(df, roles, ["x3"])], slot_seconds=slot_seconds)
    return state.where("act_all_n > 0").selectExpr("game_session", *x3_columns(roles))


def x4(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    """Largest, mean and spread of the final event count of earlier sessions, per title."""
    state = prior_table(anchors(df, roles), last_rows(df, roles), slot_seconds=slot_seconds)
    return state.where("x4_all_n > 0").selectExpr("game_session", *x4_columns(roles))


def x5(df: DataFrame, roles: Roles) -> DataFrame:
    """Tries, correctness, accuracy and accuracy group of each submitted session.

    A session counts as correct once, however many of its submits say so.
    """
    known = df if "right" in df.columns else parsed(df, roles)
    per_session = known.where(roles.is_submit()).groupBy(*ANCHOR).agg(
        F.max(F.when(F.col("right"), 1).otherwise(0)).cast("bigint").alias("correct"),
        F.count("world2").alias("try"),
    )
    return per_session.withColumn("accuracy", ratio(F.col("correct"), F.col("try"))).select(
        "game_session", "correct", "try", "accuracy", accuracy_group(F.col("accuracy")).alias("accuracy_group")
    )


def x6_clips(df: DataFrame, roles: Roles, attribute: str = "next", slot_seconds: int = HOUR) -> DataFrame:
    """Seconds from each clip start to the user's next row, with its score.

    By default the next row's session, title, world and time are reported, and
    the clip counts only if that title has a rule.  ``attribute='self'`` reports
    the clip's own.  A user's last row has no next row and is dropped.
    """
    if attribute not in ("next", "self"):
        raise ValueError("attribute is 'next' or 'self'")
    order = row_order(df)
    cols = ["game_session", "title", "world2", "ts"]
    known = df if "starts" in df.columns else parsed(df, roles)
    rows = known.select(*dict.fromkeys(["installation_id", *cols, *order]), "starts")
    paired = previous_row(with_slot(rows, seconds=slot_seconds), ["installation_id"], order, [*cols, "starts"]).where("prev.starts")
    timed = paired.withColumn(
        "duration", F.expr("timestampdiff(MICROSECOND, prev.ts, ts)") / F.lit(1e6)
    )
    source = "" if attribute == "next" else "prev."
    clips = timed.select("installation_id", *[F.col(f"{source}{c}").alias(c) for c in cols], "duration")
    return clips.where(F.col("title").isin(list(roles.clip_rules))).withColumn(
        "score", bucket_by_rule(F.col("duration"), F.col("title"), roles.clip_rules)
    )


def x6(df: DataFrame, roles: Roles, attribute: str = "next", slot_seconds: int = HOUR) -> DataFrame:
    """Mean earlier clip score per title; 0 for users who never watched in the world."""
    state = prior_table(anchors(df, roles), [clip_scores(x6_clips(df, roles, attribute, slot_seconds), roles)], slot_seconds=slot_seconds)
    return state.where("x6_all_any = 0 OR x6_all_n > 0").selectExpr("game_session", *x6_columns(roles))


def first_event(
    df: DataFrame, roles: Roles, prefix: str, names: Mapping[str, str], strict: bool = False,
    maxima: DataFrame | None = None, slot_seconds: int = HOUR,
) -> DataFrame:
    """Events up to the first correct answer, per game or activity.

    Only-later cases get the column's largest value, of ``maxima`` when given
    (the training result, to score a test log on the training scale).
    """
    family = first_events(df, tuple(names), strict, slot_seconds)
    state = prior_table(anchors(df, roles), [family], slot_seconds=slot_seconds)
    out = state.selectExpr("game_session", *first_columns(prefix, names, strict))
    return fill_max(out, [c for c in out.columns if c != "game_session"], maxima)


def x7(df: DataFrame, roles: Roles, **options) -> DataFrame:
    return first_event(df, roles, "x7", roles.first_game, **options)


def x8(df: DataFrame, roles: Roles, **options) -> DataFrame:
    return first_event(df, roles, "x8", roles.first_activity, **options)


def x9(df: DataFrame, roles: Roles, by_position: bool = False, slot_seconds: int = HOUR) -> DataFrame:
    """How many earlier attempts the user made at the same assessment.

    ``by_position`` instead lists a user's numbers title by title, titles in the
    order the log first shows them, and deals that list out to the user's rows
    in time order.
    """
    order = row_order(df)
    known = df if "attempt" in df.columns else parsed(df, roles)
    rows = with_slot(
        known.where("attempt").select(*dict.fromkeys(["installation_id", "title", *order])), seconds=slot_seconds
    )
    if not by_position:
        out = numbered(rows, ["installation_id", "title"], order, "position")
        return out.select("game_session", (F.col("position") - 1).alias("count"))
    placed = numbered(rows, ["installation_id"], order, "position")
    # One entry per title, so these lists are as long as the list of assessments.
    shown = rows.groupBy("title").agg(F.min(F.struct("installation_id", *order)).alias("shown"))
    sizes = rows.groupBy("installation_id", "title").agg(F.count(F.lit(1)).alias("size"))
    listed = (
        sizes.join(shown.withColumnRenamed("title", "_title"), F.col("title").eqNullSafe(F.col("_title")))
        .groupBy("installation_id")
        .agg(F.sort_array(F.collect_list(F.struct("shown", "size"))).alias("blocks"))
        .select("installation_id", F.transform("blocks", lambda b: b["size"]).alias("blocks"))
    )
    listed = listed.withColumnRenamed("installation_id", "_user")
    dealt = placed.join(listed, F.col("installation_id").eqNullSafe(F.col("_user")))
    position = F.aggregate(
        "blocks",
        F.struct((F.col("position") - 1).alias("rest"), F.lit(False).alias("found")),
        lambda at, size: F.when(at["found"] | (at["rest"] < size), F.struct(at["rest"].alias("rest"), F.lit(True).alias("found")))
        .otherwise(F.struct((at["rest"] - size).alias("rest"), F.lit(False).alias("found"))),
        lambda at: at["rest"],
    )
    return dealt.select("game_session", position.alias("count"))


def help_clicks(
    df: DataFrame, roles: Roles, prefix: str, names: Mapping[str, str], per_event: bool = False,
    slot_seconds: int = HOUR,
) -> DataFrame:
    state = prior_table(anchors(df, roles), [helps(df, prefix, tuple(names))], slot_seconds=slot_seconds)
    shown = state.where(f"{prefix}_all_any = 0 OR {prefix}_all_n > 0")
    return shown.selectExpr("game_session", *help_columns(prefix, names, per_event))


def x10(df: DataFrame, roles: Roles, per_event: bool = False, slot_seconds: int = HOUR) -> DataFrame:
    return help_clicks(df, roles, "x10", roles.help_game, per_event, slot_seconds)


def x11(df: DataFrame, roles: Roles, per_event: bool = False, slot_seconds: int = HOUR) -> DataFrame:
    return help_clicks(df, roles, "x11", roles.help_activity, per_event, slot_seconds)


def x12(df: DataFrame, roles: Roles) -> DataFrame:
    """Hour and weekday at which each assessment session began."""
    hour, dow = hour_dow(df, "ts")
    return df.where(roles.is_assessment() & (F.col("event_count") == 1)).select(
        "game_session", hour.alias("hour"), dow.alias("dayofweek")
    )


def x13(df: DataFrame, roles: Roles, strict: bool = False, slot_seconds: int = HOUR) -> DataFrame:
    """Spread, over earlier sessions of a title, of the spread of their clicks.

    ``strict`` looks at earlier clicks only.
    """
    families = click_spread_changes(df, roles, slot_seconds) if strict else [click_spreads(df, roles)]
    state = prior_table(anchors(df, roles), families, slot_seconds=slot_seconds)
    return state.where("x13_all_n > 0").selectExpr("game_session", *x13_columns(roles, strict))


def x14(df: DataFrame, roles: Roles, slot_seconds: int = HOUR) -> DataFrame:
    """Seconds between the anchor and the user's last activity in its world."""
    state = prior_table(anchors(df, roles), [activity(df, roles, ["x14"])], slot_seconds=slot_seconds)
    return state.where("x14_max IS NOT NULL").selectExpr("game_session", x14_column(state))
