"""Small hand-made event logs."""

import datetime as dt

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "installation_id string, game_session string, ts timestamp, event_count int, event_code int, "
    "event_id string, title string, type string, world2 string, event_data string"
)


def row(user, session, second, title="Chow Time", kind="Game", code=4020, count=2, event="e", world="W", data="{}"):
    return (user, session, START + dt.timedelta(seconds=second), count, code, event, title, kind, world, data)


def start(user, session, second, title="Cart Balancer (Assessment)", world="W", event="7ad3efc6"):
    return row(user, session, second, title, "Assessment", 2000, 1, event, world)


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_session(df):
    return {r["game_session"]: {k: v for k, v in r.asDict().items() if k != "game_session"} for r in df.collect()}
