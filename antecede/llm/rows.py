"""Columns by their exact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(name: str) -> Column:
    """The column of that name, also if dots or quotes are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name of theirs can clash."""
    return F.struct(*map(exact, df.columns))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
