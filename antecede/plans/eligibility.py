"""Which rows of the log count, and the anchors among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import map_category
from antecede.operators.joins import keep_matching
from antecede.operators.timeline import latest_per_key
from antecede.plans import constants as C
from antecede.plans.roles import Roles

IDENTITY = ("ts", "event_count", "game_session", "event_id")


def row_order(df: DataFrame) -> list[str]:
    """Total order of a user's rows; a log with a row id ends ties by it."""
    return [*IDENTITY, "row_id"] if "row_id" in df.columns else list(IDENTITY)


def with_world(df: DataFrame) -> DataFrame:
    """Adds the title's world as ``world2``."""
    return df.withColumn("world2", map_category(F.col("title"), C.WORLD_TITLES, C.WORLD_DEFAULT))


def label_worlds(labels: DataFrame) -> DataFrame:
    """The (user, world) pairs that have a label."""
    world = map_category(F.col("title"), C.LABEL_WORLDS, C.LABEL_WORLD_DEFAULT)
    return labels.select("installation_id", world.alias("world2")).distinct()


def anchors(df: DataFrame, roles: Roles) -> DataFrame:
    return df.where(roles.is_anchor()).select("installation_id", "world2", "game_session", "ts", "title")


def eligible_train(df: DataFrame, labelled: DataFrame, roles: Roles) -> DataFrame:
    """Rows of labelled (user, world) pairs; assessments only if submitted."""
    feed = keep_matching(df, labelled, ["installation_id", "world2"])
    submitted = feed.where(roles.is_submit()).select("game_session").distinct().withColumn("_submitted", F.lit(True))
    return (
        feed.join(submitted, "game_session", "left")
        .where(~roles.is_assessment() | F.col("_submitted"))
        .select(*df.columns)
    )


def last_assessment(df: DataFrame, roles: Roles) -> DataFrame:
    """Each user's last assessment row: its world, session and time."""
    order = row_order(df)
    return latest_per_key(
        df.where(roles.is_assessment()), ["installation_id"], order, ["world2", "game_session", "ts"]
    )


def eligible_test(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows of the world of each user's last assessment."""
    return keep_matching(df, last_assessment(df, roles), ["installation_id", "world2"])
