"""Session settings shared by tests and the benchmark, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session.  On a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("antecede")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, below ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster such
    a path would be lost together with its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    application = spark.sparkContext.applicationId
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="antecede-")
        shared = _LOCAL[application]
    return f"{shared.rstrip('/')}/antecede-{application}"


def stored(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``df`` written as a table in the work folder (a folder for each value of ``by``) and read back, and where it lies."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns)), path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the work folder and read it back.

    For a frame several branches of a plan use: they scan columns of the table
    instead of repeating the work, and a lost executor costs one task, not the
    lineage.
    """
    return stored(df)[0]


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the application.  Frames that read it can no longer be used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard_tables(spark: SparkSession) -> None:
    """Removes the application's intermediate tables.  Frames that read them can no longer be used."""
    discard(spark, work_folder(spark))
