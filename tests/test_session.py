"""Intermediate tables."""

import os

from antecede.session import discard_tables, materialize, work_folder


def test_tables_are_stored_and_can_be_discarded(spark):
    table = materialize(spark.range(10))
    assert sorted(r[0] for r in table.collect()) == list(range(10))
    folder = work_folder(spark).removeprefix("file://")
    assert folder.endswith(f"antecede-{spark.sparkContext.applicationId}") and os.listdir(folder)
    before = spark.sparkContext.getCheckpointDir()
    discard_tables(spark)
    assert not os.path.exists(folder) and os.path.exists(os.path.dirname(folder))
    assert work_folder(spark) == work_folder(spark) and spark.sparkContext.getCheckpointDir() == before
    assert materialize(spark.range(3)).count() == 3
