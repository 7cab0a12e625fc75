"""The attempt log as a store that is read by indicator, by time or by both, opening only files that may match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of indicators. A file belongs to one bucket and one day.
BUCKETS = 16


def bucket_of(pi: Column) -> Column:
    return F.pmod(F.xxhash64(pi), F.lit(BUCKETS)).cast("int")


def write(log: DataFrame, folder: str) -> None:
    """Writes (pi, ts, ...) by bucket of the indicator and day, sorted by indicator and time, so that row groups can be skipped too.

    A day's rows of one bucket go to as many files as tasks have them; ranges
    keep that to few and split a bucket that holds most rows.
    """
    rows = log.withColumns({"bucket": bucket_of(F.col("pi")), "day": F.to_date("ts")})
    rows.repartitionByRange("bucket", "day", "pi", "ts").sortWithinPartitions("bucket", "day", "pi", "ts").write.partitionBy("bucket", "day").parquet(folder)


def read(spark: SparkSession, folder: str, pi: str | None = None, since=None, until=None) -> DataFrame:
    """Attempts of an indicator, or of a span of time (``since`` included, ``until`` not), or both; the folders are chosen before any file is opened."""
    rows = spark.read.parquet(folder)
    if pi is not None:
        rows = rows.filter((F.col("bucket") == bucket_of(F.lit(pi))) & (F.col("pi") == pi))
    if since is not None:
        rows = rows.filter((F.col("day") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
    if until is not None:
        rows = rows.filter((F.col("day") <= F.to_date(F.lit(until))) & (F.col("ts") < F.lit(until)))
    return rows.drop("bucket", "day")
