"""Mastery of performance indicators from the attempt log: decayed Beta means, roll-ups, thresholds and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of tiers, decay a place, prior, full coverage, least evidence, and thresholds without samples.
WEIGHTS = {"easy": 0.7, "medium": 1.0, "hard": 1.3}
DECAY, PRIOR_HITS, PRIOR, FULL, PROVISIONAL = 0.9, 1.5, 3.0, 4.0, 3.0
FALLBACK_MS = {"easy": 12_000.0, "medium": 25_000.0, "hard": 45_000.0}
LEAST_SAMPLES = 8

PI = ["user_id", "cluster", "area", "pi"]


def scoped(log: DataFrame, cluster: str = "all", level: str = "all") -> DataFrame:
    """The log of one cluster and level; ``all`` leaves a side open, so only real predicates reach the scan."""
    for name, value in (("cluster", cluster), ("level", level)):
        if value != "all":
            log = log.filter(F.col(name) == value)
    return log


def tier_weight() -> Column:
    return F.coalesce(*[F.when(F.col("difficulty") == k, v) for k, v in WEIGHTS.items()], F.lit(1.0))


def ranked(log: DataFrame, keys: list[str] = PI) -> DataFrame:
    """Adds ``recency``, 0 for the newest attempt of a key; equal times keep the log's order."""
    return log.withColumn("recency", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts"), "id")) - 1)


def pi_stats(log: DataFrame, keys: list[str] = PI) -> DataFrame:
    """Decayed weighted mastery, coverage and evidence for each key; one shuffle on the key serves rank and sum."""
    w = tier_weight() * F.pow(F.lit(DECAY), F.col("recency"))
    rows = ranked(log, keys).withColumn("w", w)
    return rows.groupBy(*keys).agg(
        ((PRIOR_HITS + F.sum(F.col("w") * F.col("correct").cast("int"))) / (PRIOR + F.sum("w"))).alias("mastery"),
        F.least(F.lit(1.0), F.sum("w") / FULL).alias("coverage"),
        F.sum("w").alias("evidence"),
        F.count("*").alias("n"),
        (F.sum("w") < PROVISIONAL).alias("provisional"),
        F.max("ts").alias("last_ts"),
    )


def universe_stats(log: DataFrame, universe: DataFrame) -> DataFrame:
    """Every catalogued indicator and every one that was seen, for each user; an unseen one has zeros."""
    users = log.select("user_id").distinct()
    whole = users.crossJoin(F.broadcast(universe))  # the catalogue is a fixed list, so rows grow with users alone
    stats = pi_stats(log)
    joined = whole.join(stats, PI, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return joined.select(*PI, zero("mastery"), zero("coverage"), zero("evidence"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("provisional", F.lit(True)).alias("provisional"), "last_ts", F.col("n").isNotNull().alias("seen"))


def area_mastery(stats: DataFrame) -> DataFrame:
    """Means over all of an area's indicators; unseen ones count as zero."""
    return stats.groupBy("user_id", "cluster", "area").agg(
        F.avg(F.col("coverage") * F.col("mastery")).alias("mastery"),
        F.avg("coverage").alias("coverage"),
        F.count_if("seen").alias("seen"),
        F.count("*").alias("pis"),
    )


def readiness(areas: DataFrame, blueprint: DataFrame) -> DataFrame:
    """Blueprint-weighted mean of area mastery for each user and cluster; an area without a weight weighs 1."""
    rows = areas.join(F.broadcast(blueprint), "area", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    total = F.sum("weight")
    return rows.groupBy("user_id", "cluster").agg(F.coalesce(F.sum(F.col("weight") * F.col("mastery")) / F.when(total != 0, total), F.lit(0.0)).alias("readiness"))


def readiness_all(by_cluster: DataFrame, log: DataFrame) -> DataFrame:
    """Mean over the clusters that a user has tried, by number of attempts."""
    tries = log.groupBy("user_id", "cluster").agg(F.count("*").alias("tries"))
    return by_cluster.join(tries, ["user_id", "cluster"]).groupBy("user_id").agg((F.sum(F.col("tries") * F.col("readiness")) / F.sum("tries")).alias("readiness"))


def weakest(stats: DataFrame, k: int = 12) -> DataFrame:
    """The k weakest indicators of each user: 0.55 if unseen, else what mastery lacks, less for little evidence."""
    weakness = F.when(~F.col("seen"), 0.55).otherwise((1 - F.col("mastery")) * F.when(F.col("provisional"), 0.7).otherwise(1.0))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(F.round("weakness", 9)), F.asc_nulls_first("last_ts"), "cluster", "area", "pi"))
    return stats.withColumn("weakness", weakness).withColumn("place", place).filter(F.col("place") <= k)


def accuracy(log: DataFrame, keys: list[str]) -> DataFrame:
    answered, right = F.count_if(F.col("chosen").isNotNull()), F.count_if("correct")
    return log.groupBy(*keys).agg(answered.alias("answered"), right.alias("correct"), F.coalesce(F.try_divide(right, answered), F.lit(0.0)).alias("accuracy"))


def accuracy_by_tier(log: DataFrame, window: int = 80) -> DataFrame:
    """Accuracy of each tier among a user's newest attempts; below three of a tier the overall one, without any 0.5."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "id"))
    rows = log.withColumn("place", place).filter(F.col("place") <= window)
    whole = F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.5))
    tier = lambda t: F.when(F.count_if(F.col("difficulty") == t) >= 3, F.avg(F.when(F.col("difficulty") == t, F.col("correct").cast("int")))).otherwise(whole).alias(t)
    return rows.groupBy("user_id").agg(*[tier(t) for t in WEIGHTS])


def thresholds(log: DataFrame, keys: list[str] = ["user_id"]) -> DataFrame:
    """Median time of each tier if it has eight samples, else the fixed one."""
    tier = lambda t: F.when(F.count_if(F.col("difficulty") == t) >= LEAST_SAMPLES, F.median(F.when(F.col("difficulty") == t, F.col("elapsed_ms")))).otherwise(FALLBACK_MS[t]).alias(f"{t}_ms")
    return log.groupBy(*keys).agg(*[tier(t) for t in ("easy", "hard")])


def error_log(log: DataFrame) -> DataFrame:
    """A row for each question that a user has missed: misses, the last miss (of equal times the later logged), its pattern, and whether the newest attempt is right."""
    order = F.struct("ts", "id")
    miss = F.when(~F.col("correct"), order)
    rows = log.groupBy("user_id", "question_id").agg(
        F.count_if(~F.col("correct")).alias("misses"),
        F.max_by(F.struct("ts", "cluster", "area", "pi", "difficulty", "chosen", "elapsed_ms"), miss).alias("last_miss"),
        F.max("ts").alias("last_ts"),
        F.max_by("correct", order).alias("resolved"),
    )
    rows = rows.filter("misses > 0").join(thresholds(log), "user_id")
    return rows.select("user_id", "question_id", "misses", "last_miss.*", "last_ts", "resolved", pattern(F.col("last_miss")).alias("pattern"))


def pattern(miss: Column) -> Column:
    """careless: easy and quicker than the median; slow: hard and slower; else missed, as is a skipped question."""
    quick = (miss["difficulty"] == "easy") & (miss["elapsed_ms"] < F.col("easy_ms"))
    slow = (miss["difficulty"] == "hard") & (miss["elapsed_ms"] > F.col("hard_ms"))
    return F.when(miss["chosen"].isNull(), "missed").when(quick, "careless").when(slow, "slow").otherwise("missed")


def session_mix(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Counts of tiers for every session; sessions without attempts are kept."""
    counts = log.groupBy("session_id").agg(*[F.count_if(F.col("difficulty") == t).alias(t) for t in WEIGHTS], F.count("*").alias("total"))
    return sessions.join(counts, "session_id", "left").na.fill(0, [*WEIGHTS, "total"])


def sessions(log: DataFrame) -> DataFrame:
    """Sessions as absolute sums over the log, so writing them again changes nothing; some are still open."""
    rows = log.groupBy("session_id", "user_id").agg(F.min("ts").alias("ts"), F.max("ts").alias("ended"), F.count("*").alias("total"), F.count("chosen").alias("answered"), F.count_if("correct").alias("correct"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return rows.withColumn("ended_ts", F.when(F.col("user_id") % 11 != 5, F.col("ended"))).drop("ended")


#: Attempts of a block in which decayed sums run.
BLOCK = 256


def trajectory(log: DataFrame, universe: DataFrame, blueprint: DataFrame) -> DataFrame:
    """Readiness of each user and cluster after each of its attempts, without replaying the log for each point.

    Newer attempts push older ones a place down, so an indicator's sums obey
    S' = w + 0.9 S. Each attempt changes one indicator's share of its area,
    and the shares' running sum is the readiness. Indicators outside the
    catalogue are left out. S is a running sum over a block of 256 attempts,
    scaled by powers of 0.9, and what the blocks before it leave: the last two
    of them, since a third would add less than the 1e-34th part.
    """
    by_pi = W.partitionBy(*PI).orderBy("ts", F.desc("id"))
    rows = log.join(F.broadcast(universe), ["cluster", "area", "pi"], "left_semi").withColumns({"w": tier_weight(), "nth": F.row_number().over(by_pi) - 1})
    rows = rows.withColumns({"block": F.floor(F.col("nth") / BLOCK), "at": F.col("nth") % BLOCK})
    here = W.partitionBy(*PI, "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    ago = lambda k: W.partitionBy(*PI).orderBy("block").rangeBetween(-k, -k)

    def decayed(value):
        own = F.sum(value * F.pow(F.lit(DECAY), -F.col("at"))).over(here) * F.pow(F.lit(DECAY), F.col("at"))
        left = lambda k: F.coalesce(F.sum(value * F.pow(F.lit(DECAY), F.lit(BLOCK - 1) - F.col("at"))).over(ago(k)), F.lit(0.0))
        return own + F.pow(F.lit(DECAY), F.col("at") + 1) * (left(1) + DECAY**BLOCK * left(2))

    rows = rows.withColumns({"s": decayed(F.col("w")), "c": decayed(F.col("w") * F.col("correct").cast("int"))})
    rows = rows.withColumn("share", F.least(F.lit(1.0), F.col("s") / FULL) * (PRIOR_HITS + F.col("c")) / (PRIOR + F.col("s")))
    rows = rows.withColumn("step", F.col("share") - F.coalesce(F.lag("share").over(by_pi), F.lit(0.0)))
    sizes = universe.groupBy("cluster", "area").agg(F.count("*").alias("pis"))
    weights = sizes.join(F.broadcast(blueprint), "area", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    totals = weights.groupBy("cluster").agg(F.sum("weight").alias("all_weight"))
    rows = rows.join(F.broadcast(weights), ["cluster", "area"]).join(F.broadcast(totals), "cluster")
    running = W.partitionBy("user_id", "cluster").orderBy("ts", F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    return rows.select("user_id", "cluster", "id", "ts", F.sum(F.col("step") / F.col("pis") * F.col("weight") / F.col("all_weight")).over(running).alias("readiness"))


def day_best(points: DataFrame, most: int = 14) -> DataFrame:
    """With more than 14 points the best of each day, of equal ones the latest; else all points."""
    day = F.to_date("ts")
    many = F.count("*").over(W.partitionBy("user_id", "cluster")) > most
    place = F.row_number().over(W.partitionBy("user_id", "cluster", day).orderBy(F.desc(F.round("readiness", 9)), F.desc("ts"), F.desc("id")))
    return points.withColumns({"many": many, "place": place}).filter(~F.col("many") | (F.col("place") == 1)).drop("many", "place")
