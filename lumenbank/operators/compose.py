"""Composing question sets and study plans: quotas, draws, priorities and hash-ordered picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators.bank import largest_remainder
from lumenbank.operators.ranks import numbered


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable random order: the same for a seed, whatever the partitioning."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256)


def shuffled(rows: DataFrame, seed: int, keys: list[str], key: str = "id") -> DataFrame:
    """Adds ``place``, a seeded order of each group; for those who take the first few, which Spark limits before rows meet."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(hash_order(F.col(key), seed), key)))


def shuffled_whole(rows: DataFrame, seed: int, keys: list[str], key: str = "id") -> DataFrame:
    """The same order of whole groups, none of which is held by a task."""
    turn = rows.withColumn("_turn", hash_order(F.col(key), seed))
    return numbered(turn, keys, [F.col("_turn"), F.col(key)]).drop("_turn")


def balanced_values(rows: DataFrame, values: list[str], seed: int, keys: list[str], name: str = "value") -> DataFrame:
    """Cycles ``values`` over each group's shuffled rows, so counts differ by one at most."""
    rows = shuffled_whole(rows, seed, keys)
    return rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("place") - 1, F.lit(len(values))) + 1).cast("int")))


def rotation_pick(keys: DataFrame, pool: list[str], name: str = "pick") -> DataFrame:
    """An entry of the pool by the key's hash: the first 64 bits of its SHA-256, modulo the pool's size."""
    number = F.conv(F.substring(F.sha2(F.col("key"), 256), 1, 15), 16, 10).cast("long")
    return keys.withColumn(name, F.element_at(F.array(*map(F.lit, pool)), (F.pmod(number, F.lit(len(pool))) + 1).cast("int")))


def question_quotas(areas: DataFrame, total: int, group: list[str]) -> DataFrame:
    """Questions of each area: by largest remainder over the areas' counts."""
    return largest_remainder(areas.withColumn("total", F.lit(total)), group, "n", "total", "area").drop("total")


def draw(rows: DataFrame, quotas: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Of each key's shuffled rows as many as its quota; what a key lacks stays short."""
    ordered = shuffled(rows, seed, keys)
    return ordered.join(quotas.select(*keys, "quota"), keys).filter(F.col("place") <= F.col("quota"))


def compose_test(rows: DataFrame, tier_quotas: dict[str, int], group: str, seed: int) -> DataFrame:
    """A test for each group: each tier's quota from its shuffled rows, and missing ones from the nearest other tiers.

    Every row gets a rank in its tier. Own rows come within the quota; rows
    beyond it may be borrowed, nearest tier first, until the group's total is
    reached. ``borrowed`` tells which were.
    """
    tiers = list(tier_quotas)
    total = sum(tier_quotas.values())
    # No tier gives more than the whole test, so each task drops the rest before rows meet.
    ordered = shuffled(rows, seed, [group, "difficulty"]).filter(F.col("place") <= total)
    quota = F.coalesce(*[F.when(F.col("difficulty") == t, q) for t, q in tier_quotas.items()], F.lit(0))
    near = F.coalesce(*[F.when(F.col("difficulty") == t, abs(i - 1)) for i, t in enumerate(tiers)], F.lit(9))
    ordered = ordered.withColumns({"borrowed": F.col("place") > quota, "near": near})
    ordered = ordered.withColumn("slot", F.row_number().over(W.partitionBy(group).orderBy("borrowed", "near", "place", "id")))
    return ordered.filter(F.col("slot") <= total).select("id", group, "difficulty", "borrowed", "slot")


def draw_for_indicator(rows: DataFrame, asked: DataFrame, n: int, seed: int) -> DataFrame:
    """n questions for each asked (cluster, area, pi): its own first, then the area's others; the source is told."""
    own = asked.join(rows, ["cluster", "area", "pi"]).select("cluster", "area", "pi", "id", F.lit(0).alias("rank"))
    other = asked.join(rows.withColumnRenamed("pi", "from_pi"), ["cluster", "area"]).filter("from_pi <> pi").select("cluster", "area", "pi", "id", F.lit(1).alias("rank"))
    w = W.partitionBy("cluster", "area", "pi").orderBy("rank", hash_order(F.col("id"), seed), "id")
    drawn = own.unionByName(other).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return drawn.withColumn("source", F.when(F.col("rank") == 0, "pi").otherwise("area")).drop("rank")


def pacing(plans: DataFrame) -> DataFrame:
    """Days left and expected readiness between start and event day: .82 of the share of time gone, with a band of .06."""
    gone = F.datediff("today", "start_day") / F.greatest(F.datediff("event_day", "start_day"), F.lit(1))
    expected = 0.82 * F.least(F.greatest(gone, F.lit(0.0)), F.lit(1.0))
    rows = plans.withColumns({"days_left": F.greatest(F.datediff("event_day", "today"), F.lit(0)), "expected": expected})
    return rows.withColumn("pace", F.when(F.col("readiness") > F.col("expected") + 0.06, "ahead").when(F.col("readiness") < F.col("expected") - 0.06, "behind").otherwise("on track"))


def study_plan(stats: DataFrame, areas: DataFrame, users: DataFrame, budget: int = 5) -> DataFrame:
    """Each user's tasks by rule order, up to the budget: warm-up for few attempts, weak indicators, an untouched one of the weakest area, a challenge and a milestone.

    ``users`` has user_id, tries, readiness and days_left. The rules are small
    frames with a rule number; their union is ranked once.
    """
    few = users.filter("tries < 12").select("user_id", F.lit(0).alias("rule"), F.lit("warm-up").alias("task"), F.lit(None).cast("string").alias("pi"))
    weak_place = F.row_number().over(W.partitionBy("user_id").orderBy(F.round("mastery", 9), "cluster", "area", "pi"))
    weak = stats.filter("seen AND mastery < 0.6").withColumn("p", weak_place).filter("p <= 3").select("user_id", F.lit(1).alias("rule"), F.lit("weak").alias("task"), F.concat_ws("/", "cluster", "area", "pi").alias("pi"))
    area_place = F.row_number().over(W.partitionBy("user_id").orderBy(F.round(F.col("mastery"), 9), "cluster", "area"))
    weakest = areas.withColumn("p", area_place).filter("p = 1").select("user_id", "cluster", "area")
    open_place = F.row_number().over(W.partitionBy("user_id").orderBy("pi"))
    new = stats.filter("NOT seen").join(weakest, ["user_id", "cluster", "area"]).withColumn("p", open_place).filter("p <= 2").select("user_id", F.lit(2).alias("rule"), F.lit("uncovered").alias("task"), F.concat_ws("/", "cluster", "area", "pi").alias("pi"))
    challenge = users.filter("readiness >= 0.6").select("user_id", F.lit(3).alias("rule"), F.lit("challenge").alias("task"), F.lit(None).cast("string").alias("pi"))
    milestone = users.filter("readiness >= 0.75 OR days_left <= 10").select("user_id", F.lit(4).alias("rule"), F.lit("milestone").alias("task"), F.lit(None).cast("string").alias("pi"))
    tasks = reduce(DataFrame.unionByName, [few, weak, new, challenge, milestone])
    place = F.row_number().over(W.partitionBy("user_id").orderBy("rule", F.asc_nulls_first("pi")))
    return tasks.withColumn("place", place).filter(F.col("place") <= budget)


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of an ordered frame; a number beyond the last page gives the last."""
    n = rows.count()
    number = max(0, min(number, -(-n // size) - 1))
    return rows.orderBy(*order).offset(number * size).limit(size)


def ladder(low: Column, high: Column, rungs: int = 4) -> Column:
    """An arithmetic ladder of whole lengths inset in a band, rounded half to even."""
    step = (high - low) / (rungs + 1)
    return F.transform(F.sequence(F.lit(1), F.lit(rungs)), lambda i: F.bround(low + step * i).cast("int"))
