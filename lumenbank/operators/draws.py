"""Weighted draws without replacement in two strata, seeded and the same however rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chance(*parts: Column) -> Column:
    """A number in (0, 1) from the SHA-256 of the parts."""
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("double")
    return (number + 0.5) / float(1 << 48)


def race(weight: Column, *parts: Column) -> Column:
    """The least of these wins: each comes first in proportion to its weight, and the k least are a weighted draw without replacement."""
    return -F.log(chance(*parts)) / weight


def select_indicators(events: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """(event, place, area, pi, role): of each event its core, from one area, then what is adjacent to it.

    ``events`` has (event, pi_count, core_min), ``candidates`` (event, area,
    weight, tier, pi, key): tier ``in`` or ``near``, key the indicator's normalised spelling. An area is
    drawn by its weight among those with ``core_min`` keys of tier in; the core
    is drawn from these keys, and the rest from the other areas' and all near
    ones. Each draw is by key, of which the first spelling stands (tier in before near, then area, then pi), so
    no indicator comes twice. An event without such an area has no rows; one with too few others has what there is.
    """
    salt = F.lit(str(seed))
    first = F.row_number().over(W.partitionBy("event", "area", "key").orderBy("pi"))
    inside = candidates.filter("tier = 'in'").withColumn("nth", first).filter("nth = 1").drop("nth")
    areas = inside.groupBy("event", "area").agg(F.count("*").alias("keys"), F.max("weight").alias("weight")).join(events, "event").filter((F.col("keys") >= F.col("core_min")) & (F.col("weight") > 0))
    drawn = areas.groupBy("event", "pi_count", "core_min").agg(F.min_by("area", F.struct(race(F.col("weight"), F.col("event"), F.col("area"), salt), "area")).alias("declared"))

    order = lambda: W.partitionBy("event").orderBy(chance(F.col("event"), F.col("key"), salt), "key")
    core = inside.join(drawn, "event").filter("area = declared").withColumn("place", F.row_number().over(order())).filter(F.col("place") <= F.col("core_min"))
    core = core.select("event", "place", "area", "pi", "key", F.lit("core").alias("role"))

    others = candidates.join(drawn, "event").filter("tier = 'near' OR area <> declared")
    others = others.join(core.select("event", "key"), ["event", "key"], "left_anti")
    # One spelling of a key, by an aggregate: a frequent key is reduced before it is shuffled.
    spelt = others.groupBy("event", "key", "pi_count", "core_min").agg(F.min(F.struct((F.col("tier") == "near").alias("near"), "area", "pi")).alias("x"))
    rest = spelt.withColumn("nth", F.row_number().over(order())).filter(F.col("nth") <= F.col("pi_count") - F.col("core_min"))
    rest = rest.select("event", (F.col("core_min") + F.col("nth")).alias("place"), "x.area", "x.pi", "key", F.lit("adjacent").alias("role"))
    return core.unionByName(rest).select("event", "place", "area", "pi", "role")
