"""Places of rows within a key, numbered over ranges of (key, order), so that no task holds a whole key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.sources.storage import saved

#: Rows of a counted side that may be broadcast.
FEW = 100_000

#: monotonically_increasing_id() counts from here on in each partition.
PARTITION_BITS = 33


def counted(side: DataFrame, most: int = FEW) -> DataFrame:
    """A saved join side, broadcast up to ``most`` rows and left to a shuffled join beyond."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of ``keys`` in which nulls are equal."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def placed(df: DataFrame, keys: list[str], order: list[Column], place: str = "place", size: str = "size") -> DataFrame:
    """Adds ``place``, from 0 in ``order`` within ``keys`` (null is a key of its own), and ``size``, the rows of the key.

    Rows are dealt by ranges of keys and order, sorted and saved with their
    number in the partition; each (partition, key) is counted and what the
    earlier partitions of its key hold is added. A key with most of the rows is
    spread over many partitions; rows equal in ``order`` too may be split, in no set order.
    The counts have a row for each key and one more for each border of partitions.
    """
    number, part = F.col("_number"), F.shiftright("_number", PARTITION_BITS)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(k).asc_nulls_first() for k in keys]
    rows = saved(tied.repartitionByRange(*by, *order, "_tie").sortWithinPartitions(*by, *order).drop("_tie").withColumn("_number", F.monotonically_increasing_id()))
    runs = rows.groupBy(*keys, part.alias("_part")).agg(F.min(number).alias("_first"), F.count("*").alias("_n"))
    whole = W.partitionBy(*[F.col(k) for k in keys])
    earlier = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = counted(saved(runs.select(*keys, "_part", (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias(size))))
    joined = rows.join(runs, same(rows, runs, keys) & (part == F.col("_part")))
    return joined.select(*[rows[c] for c in df.columns], (number + F.col("_shift")).alias(place), size)


def tiles(n: int, place: str = "place", size: str = "size") -> Column:
    """The tile, from 1 to ``n``, of a place among ``size``: the first ones have a row more where they don't divide."""
    q, r = F.floor(F.col(size) / n), F.col(size) % n
    wide = r * (q + 1)
    return F.when(F.col(place) < wide, F.floor(F.col(place) / (q + 1))).otherwise(r + F.floor((F.col(place) - wide) / F.greatest(q, F.lit(1)))).cast("int") + 1


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds ``name``, from 1: what row_number() gives, without a task that holds a whole key."""
    return placed(rows, keys, order, "_place", "_size").withColumn(name, F.col("_place") + 1).drop("_place", "_size")
