"""Readers and writers.

Every CSV scan has an explicit schema and ``escape='"'``.  Without the escape a
doubled quote inside the JSON payload splits the field and shifts every later
column without an error; with schema inference an id such as ``0001e90f`` is
read as a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antecede.session import materialize

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("game_session", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_data", T.StringType()),
        T.StructField("installation_id", T.StringType()),
        T.StructField("event_count", T.IntegerType()),
        T.StructField("event_code", T.IntegerType()),
        T.StructField("game_time", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("world", T.StringType()),
    ]
)

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("game_session", T.StringType()),
        T.StructField("installation_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("num_correct", T.IntegerType()),
        T.StructField("num_incorrect", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("accuracy_group", T.IntegerType()),
    ]
)

TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("installation_id", T.StringType()),
        T.StructField("accuracy_group", T.IntegerType()),
    ]
)


BAD = "_bad_line"


def _present(schema: T.StructType, present: list[str] | None) -> T.StructType:
    if not present:
        return schema
    known = {f.name: f for f in schema}
    unknown = [name for name in present if name not in known]
    if unknown:
        raise ValueError(f"columns without a declared type: {unknown}")
    return T.StructType([known[name] for name in present])


def _csv(spark: SparkSession, path: str, schema: T.StructType, present: list[str] | None) -> DataFrame:
    return spark.read.csv(path, schema=_present(schema, present), header=True, escape='"', enforceSchema=False, mode="FAILFAST")


def read_with_quarantine(
    spark: SparkSession, path: str, schema: T.StructType, present: list[str] | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file that fit the schema, and the lines that do not: file and line.

    A line does not fit if it has more or fewer fields than the schema, or a field that is not of its type.  Empty fields
    are NULL and fit.  All is parsed once, into a table that both results read.  ``header``: whether each file begins with one,
    which is not checked.
    """
    wanted = _present(schema, present)
    parsed = spark.read.csv(
        path, schema=T.StructType([*wanted, T.StructField(BAD, T.StringType())]), header=header, escape='"', mode="PERMISSIVE",
        columnNameOfCorruptRecord=BAD,
    )
    rows = materialize(parsed.withColumn("_file", F.col("_metadata.file_path")))
    good = rows.where(F.col(BAD).isNull()).select(*wanted.fieldNames())
    return good, rows.where(F.col(BAD).isNotNull()).select(F.col("_file").alias("file"), F.col(BAD).alias("line"))


def read_events(spark: SparkSession, path: str, present: list[str] | None = None) -> DataFrame:
    """Event log with its ``timestamp`` column as ``ts``.

    ``present`` names the columns of the file, in file order, when it has fewer
    than ``EVENT_SCHEMA``.  The header is checked against the schema.
    """
    return _csv(spark, path, EVENT_SCHEMA, present).withColumnRenamed("timestamp", "ts")


def write_events(df: DataFrame, path: str) -> None:
    """A log as CSV files that ``read_events`` reads back: payloads quoted, instants with microseconds."""
    names = [f.name for f in EVENT_SCHEMA if f.name in df.columns or (f.name == "timestamp" and "ts" in df.columns)]
    rows = df.withColumnRenamed("ts", "timestamp").select(*names)
    rows.write.mode("errorifexists").csv(path, header=True, escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def read_labels(spark: SparkSession, path: str, present: list[str] | None = None) -> DataFrame:
    return _csv(spark, path, LABEL_SCHEMA, present)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """The list of users a submission must answer for."""
    return _csv(spark, path, TEMPLATE_SCHEMA, None)


def with_file_order(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows just read from files, with their place (from 0) in the files' order: by file, then by place in the file.

    A large file is read in several pieces; each row is numbered in its piece, and only the number of rows of each piece
    is added up over the pieces.  The files are read twice.
    """
    part = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # A task may read several pieces, each in order.
    rows = materialize(df.select("*", part.alias("_piece"), F.monotonically_increasing_id().alias("_at")))
    pieces = rows.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = pieces.select("_piece", "_first", (F.sum("_n").over(Window.orderBy("_piece")) - F.col("_n")).alias("_before"))  # few rows
    return rows.join(F.broadcast(before), "_piece").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, name)


def write_in_order(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str]) -> None:
    """CSV files that in the order of their names hold the rows by ``order``: ranges of it, each sorted by one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(*columns).write.mode("errorifexists").csv(path, header=True)


def write_submission(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with a header, many files, so no task holds all rows; in ``order`` over all files if given."""
    columns = ["installation_id", "accuracy_group"]
    if order:
        write_in_order(df, path, order, columns)
    else:
        df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def write_by_date(df: DataFrame, path: str, ts: str = "ts", day: str = "date") -> None:
    """A log as Parquet, a folder for each day.  Ranges of time keep a task to a few days, and split a busy day."""
    dated = df.withColumn(day, F.to_date(ts))
    dated.repartitionByRange(day, ts).write.mode("errorifexists").partitionBy(day).parquet(path)


def rows_of_days(log: DataFrame, wanted: DataFrame, day: str = "date", back: int = 0) -> DataFrame:
    """Rows of a log by day on the days of ``wanted`` (a column ``day``) and ``back`` days before.

    Spark reads the days' folders only: it learns them when ``wanted`` is known, at run time.
    """
    days = wanted.select(F.explode(F.sequence(F.date_sub(day, back), F.col(day))).alias(day)).where(F.col(day).isNotNull())
    return log.join(days.distinct(), day, "left_semi")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
