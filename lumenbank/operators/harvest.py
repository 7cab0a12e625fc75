"""The library of indicators from a corpus of cases: tiers by support, published additions, promotions and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: cases that put an indicator into an area.
FLOOR = 2


def spellings(corpus: DataFrame) -> DataFrame:
    """(key, pi): each indicator's commonest spelling over all cases, of equally common ones the first."""
    seen = corpus.groupBy("key", "pi").agg(F.count("*").alias("n"))
    return seen.groupBy("key").agg(F.min_by("pi", F.struct((-F.col("n")).alias("less"), "pi")).alias("pi"))


def support(corpus: DataFrame) -> DataFrame:
    """(area, key, cases): different cases that list an indicator under an area."""
    return corpus.groupBy("area", "key").agg(F.count_distinct("case").alias("cases"))


def merge(corpus: DataFrame, library: DataFrame, published: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(area, key, pi, tier, origin): what each area's list is to hold, from cases (case, area, pi, key), the old library and published lists (area, pi, key).

    An area of the corpus has the indicators of ``floor`` cases or more in tier
    ``in`` and the others in tier ``near``; its old list goes. An area that no
    case has keeps its old lines, but for those that the corpus puts elsewhere.
    Published lines join their area's tier in, where they are new, whatever
    their support; an indicator that thereby stands in both tiers is promoted
    and leaves tier near. Support is not counted again after promotions, so one pass is the fixed point.
    """
    tiers = support(corpus).withColumn("tier", F.when(F.col("cases") >= floor, "in").otherwise("near"))
    harvested = tiers.join(spellings(corpus), "key").select("area", "key", "pi", "tier", F.lit("corpus").alias("origin"))
    areas, keys = corpus.select("area").distinct(), corpus.select("key").distinct()
    kept = library.join(areas, "area", "left_anti").join(keys, "key", "left_anti")
    kept = kept.groupBy("area", "key").agg(F.min("pi").alias("pi")).select("area", "key", "pi", F.lit("in").alias("tier"), F.lit("library").alias("origin"))
    base = harvested.unionByName(kept)
    listed = published.groupBy("area", "key").agg(F.min("pi").alias("pi"))
    fresh = listed.join(base.filter("tier = 'in'").select("area", "key"), ["area", "key"], "left_anti").select("area", "key", "pi", F.lit("in").alias("tier"), F.lit("published").alias("origin"))
    near = base.filter("tier = 'near'").join(fresh.select("area", "key"), ["area", "key"], "left_anti")
    return base.filter("tier = 'in'").unionByName(near).unionByName(fresh)


def conflicts(corpus: DataFrame, library: DataFrame) -> DataFrame:
    """(area, key, pi, homes): library lines whose indicator the corpus has under other areas only."""
    homes = corpus.groupBy("key").agg(F.array_sort(F.collect_set("area")).alias("homes"))
    return library.join(homes, "key").filter(~F.array_contains("homes", F.col("area"))).select("area", "key", "pi", "homes")


def starved(lists: DataFrame, quotas: DataFrame) -> DataFrame:
    """(event, area, have, core_min): areas of events whose tier in cannot fill the event's core; ``quotas`` has (event, area, core_min)."""
    have = lists.filter("tier = 'in'").groupBy("area").agg(F.count("*").alias("have"))
    return quotas.join(have, "area", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < F.col("core_min")).select("event", "area", "have", "core_min")
