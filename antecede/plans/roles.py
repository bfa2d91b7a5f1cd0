"""What plays which part in a log: the configuration of every feature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.operators.frames import category_values
from antecede.plans import constants as C


@dataclass(frozen=True)
class Roles:
    """Conditions are Spark SQL texts over the columns of the event log."""

    assessment: str = "Assessment"
    start_code: int = C.START_CODE
    submit_code: int = C.SUBMIT_CODE
    submit_code_by_title: Mapping[str, int] = field(default_factory=dict)
    clip_start: str = "false"
    clip_rules: Mapping[str, Sequence[float]] = field(default_factory=dict)
    attempt: str = "false"
    first_game: Mapping[str, str] = field(default_factory=dict)
    first_activity: Mapping[str, str] = field(default_factory=dict)
    help_game: Mapping[str, str] = field(default_factory=dict)
    help_activity: Mapping[str, str] = field(default_factory=dict)
    # Categories that become columns; observed() finds them in a log.
    titles: tuple[str, ...] = ()
    codes: tuple[int, ...] = ()
    title_codes: tuple[str, ...] = ()

    def is_assessment(self) -> Column:
        return F.col("type").eqNullSafe(self.assessment)

    def is_anchor(self) -> Column:
        return self.is_assessment() & (F.col("event_code") == self.start_code)

    def is_submit(self) -> Column:
        wanted = F.lit(self.submit_code)
        for title, code in self.submit_code_by_title.items():
            wanted = F.when(F.col("title") == title, F.lit(code)).otherwise(wanted)
        return self.is_assessment() & (F.col("event_code") == wanted)

    def observed(self, df: DataFrame) -> Roles:
        """These roles with the categories of ``df`` outside assessments."""
        rest = df.where(~self.is_assessment())
        pairs = rest.select(F.concat("title", F.lit("_"), F.col("event_code").cast("string")).alias("title_code"))
        return replace(
            self,
            titles=tuple(category_values(rest, "title")),
            codes=tuple(category_values(rest, "event_code")),
            title_codes=tuple(category_values(pairs, "title_code")),
        )


GAME = Roles(
    submit_code_by_title=C.SUBMIT_CODE_BY_TITLE,
    clip_start=f"event_id = '{C.CLIP_START}'",
    clip_rules=C.CLIP_RULES,
    attempt="type = 'Assessment' AND event_id IN ({})".format(", ".join(f"'{i}'" for i in C.ASSESSMENT_STARTS)),
    first_game=C.FIRST_CORRECT_GAME,
    first_activity=C.FIRST_CORRECT_ACTIVITY,
    help_game=C.HELP_GAME,
    help_activity=C.HELP_ACTIVITY,
)
