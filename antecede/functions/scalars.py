"""Column expressions.  All are Spark built-ins; none is a Python function on rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: object) -> str:
    """A column-name-safe spelling of a category label; one that would lose letters ends with a digest."""
    text = str(text)
    plain = re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")
    return plain if text.isascii() and plain else f"{plain}_{_digest(text)}".lstrip("_")


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]


def slugs(labels: Iterable[object]) -> list[str]:
    """Distinct spellings of distinct labels: those that would be alike all end with a digest."""
    texts = [str(v) for v in labels]
    alike = Counter(map(slug, texts))
    return [slug(t) if alike[slug(t)] == 1 else f"{slug(t)}_{_digest(t)}" for t in texts]


def micros(df: DataFrame, ts: str) -> str:
    """SQL text for the microseconds since 1970, for either timestamp type."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)"
    return f"unix_micros(`{ts}`)"


def seconds_between(earlier: str, later: str) -> Column:
    """Fractional seconds; the SECOND unit would truncate."""
    return F.expr(f"timestampdiff(MICROSECOND, `{earlier}`, `{later}`)") / F.lit(1e6)


def json_flag(payload: Column, name: str) -> Column:
    """Letters after ``"name":``, key and value matched in any case; '' if absent."""
    return F.regexp_extract(payload, f'(?i)"{name}":([a-z]+)', 1)


def has_xy(payload: Column) -> Column:
    """True when a whole-number x is followed, later in the text, by such a y."""
    return payload.rlike('("x":[0-9]+).+("y":[0-9]+)')


def json_int(payload: Column, name: str) -> Column:
    """Digits after ``"name":``; a decimal stops at its point, a negative is NULL."""
    return F.regexp_extract(payload, f'"{name}":([0-9]+)', 1).try_cast("bigint")


def hour_dow(df: DataFrame, ts: str) -> tuple[Column, Column]:
    """Hour of the day, and the weekday with Monday as 0, in UTC whatever the session's zone.

    1970-01-01 was a Thursday.
    """
    hours = F.floor(F.expr(micros(df, ts)) / F.lit(3_600_000_000.0))
    return F.pmod(hours, F.lit(24)).cast("int"), F.pmod(F.floor(hours / 24) + 3, F.lit(7)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """NULL, not an error, for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def accuracy_group(accuracy: Column) -> Column:
    return (
        F.when(accuracy == 1, 3).when(accuracy >= 0.5, 2).when(accuracy > 0, 1).otherwise(0).cast("int")
    )


def map_category(col: Column, mapping: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """Name of the first group listing the value; NULL for the group named ''."""
    out = None
    for group, members in mapping.items():
        result = F.lit(group) if group else F.lit(None).cast("string")
        test = col.isin(list(members))
        out = F.when(test, result) if out is None else out.when(test, result)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def bucket_by_rule(value: Column, label: Column, rules: Mapping[str, Sequence[float]]) -> Column:
    """Score 0, 1, 2 by the label's three thresholds; 0 above the last one.

    The rules are configuration, so they travel as a literal inside the plan.
    """
    limits = F.create_map(
        *[part for key, row in rules.items() for part in (F.lit(key), F.array(*[F.lit(float(v)) for v in row]))]
    )
    row = limits[label]
    return (
        F.when(value <= row[0], 0).when(value <= row[1], 1).when(value <= row[2], 2).otherwise(0).cast("int")
    )


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
