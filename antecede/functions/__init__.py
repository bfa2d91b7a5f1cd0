from antecede.functions.scalars import (
    accuracy_group,
    argmax,
    bucket_by_rule,
    has_xy,
    hour_dow,
    json_flag,
    json_int,
    map_category,
    micros,
    ratio,
    seconds_between,
    slug,
    slugs,
)

__all__ = [
    "accuracy_group",
    "argmax",
    "bucket_by_rule",
    "has_xy",
    "hour_dow",
    "json_flag",
    "json_int",
    "map_category",
    "micros",
    "ratio",
    "seconds_between",
    "slug",
    "slugs",
]
