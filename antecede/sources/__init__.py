from antecede.sources.files import (
    EVENT_SCHEMA,
    LABEL_SCHEMA,
    TEMPLATE_SCHEMA,
    load,
    read_events,
    read_labels,
    read_template,
    read_with_quarantine,
    rows_of_days,
    with_file_order,
    write_by_date,
    write_events,
    write_in_order,
    write_submission,
)

__all__ = [
    "EVENT_SCHEMA",
    "LABEL_SCHEMA",
    "TEMPLATE_SCHEMA",
    "load",
    "read_events",
    "read_labels",
    "read_template",
    "read_with_quarantine",
    "rows_of_days",
    "with_file_order",
    "write_by_date",
    "write_events",
    "write_in_order",
    "write_submission",
]
