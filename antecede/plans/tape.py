"""The log read once for all features.

One scan turns each row into the entries that the features need of it, a tagged tape, and stores them by tag: an entry holds
only the columns its feature uses, payloads are parsed once, and each feature then reads its own part of the tape.
The parts keep the log's column names, so the functions of single features take them as they take a log.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import has_xy, json_flag, json_int
from antecede.plans.eligibility import row_order
from antecede.plans.roles import Roles
from antecede.session import stored

PART = "part"
KEYS = ("installation_id", "world2", "game_session", "title", "ts")


@dataclass(frozen=True)
class Tape:
    """Where the parts lie, and which columns each has."""

    rows: DataFrame
    parts: Mapping[str, tuple[str, ...]]

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col(PART) == name).select(*self.parts[name])


def parsed(df: DataFrame, roles: Roles) -> DataFrame:
    """``df`` with what its conditions and payloads say: starts, attempt, right, x and y (NULL unless both are whole numbers)."""
    clicked = has_xy(F.col("event_data"))
    return df.withColumns({
        "starts": F.expr(roles.clip_start), "attempt": F.expr(roles.attempt),
        "right": json_flag(F.col("event_data"), "correct") == "true",
        "clicked": clicked,
        "x": F.when(clicked, json_int(F.col("event_data"), "x")), "y": F.when(clicked, json_int(F.col("event_data"), "y")),
    })


def log_tape(df: DataFrame, roles: Roles) -> Tape:
    """The tape of an eligible log.  Runs a job, the only one that reads ``df``."""
    order = row_order(df)
    first, helps = [*roles.first_game, *roles.first_activity], [*roles.help_game, *roles.help_activity]
    rest = ~roles.is_assessment()
    wanted: dict[str, tuple[Column, list[str]]] = {
        "activity": (rest, [*KEYS, "type", "event_code", "event_id", "event_count"]),
        "first": (F.col("event_id").isin(first), [*KEYS, "event_id", "event_count"]),
        "help": (F.col("event_id").isin(helps), ["installation_id", "world2", "ts", "event_id"]),
        "click": (rest & F.col("clicked"), [*KEYS, "type", *order, "clicked", "x", "y"]),
        "clip": (F.lit(True), [*KEYS, *order, "starts"]),
        "assessment": (roles.is_assessment(), [*KEYS, "type", "event_code", "event_count", "right"]),
        "attempt": (F.col("attempt"), [*KEYS, *order, "attempt"]),
    }
    columns = {name: tuple(dict.fromkeys(cols)) for name, (_, cols) in wanted.items()}
    every = list(dict.fromkeys(c for cols in columns.values() for c in cols))
    known = parsed(df, roles)
    types = dict(known.dtypes)
    entries = [
        F.when(test, F.struct(F.lit(name).alias(PART), *[
            (F.col(c) if c in columns[name] else F.lit(None).cast(types[c])).alias(c) for c in every
        ]))
        for name, (test, _) in wanted.items()
    ]
    tape, _ = stored(known.select(F.inline(F.array_compact(F.array(*entries)))), by=[PART])
    return Tape(tape, columns)
