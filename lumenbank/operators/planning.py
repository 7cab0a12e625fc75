"""A day's study plan for every user: recommended tasks by need, with the user's own edits, sizes and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Attempts below which a user is new, tasks of a day, thresholds, and how many questions a task asks for.
COLD, BUDGET, WEAK, CHALLENGE, MILESTONE, NEAR = 12, 5, 0.6, 0.6, 0.75, 10
SIZES = {"warmup": 10, "weak-drill": 8, "coverage": 3, "challenge": 10, "milestone": 50}

SPEC = "user_id long, task_id string, type string, cluster string, area string, pi string, size int, miss_ids array<string>"


def spec(rows: DataFrame, kind: str, order: int, task_id=None, cluster=None, area=None, pi=None, within=None) -> DataFrame:
    """Recommended tasks of a kind in the form of :data:`SPEC`, with their rule and their order within it."""
    nothing = F.lit(None).cast("string")
    return rows.select(
        "user_id", (F.lit(kind) if task_id is None else task_id).alias("task_id"), F.lit(kind).alias("type"),
        (nothing if cluster is None else cluster).alias("cluster"), (nothing if area is None else area).alias("area"), (nothing if pi is None else pi).alias("pi"),
        F.lit(SIZES[kind]).alias("size"), F.lit(None).cast("array<string>").alias("miss_ids"), F.lit(order).alias("rule"), (F.lit(0) if within is None else within).alias("within"),
    )


def recommended(users: DataFrame, stats: DataFrame, areas: DataFrame) -> DataFrame:
    """What the rules call for: a warm-up for new users, weak indicators (three if behind, else two), untouched ones of the weakest
    areas (none for new users, two if behind, else one), a challenge when ready for it, and a milestone near the date or the goal.

    ``users`` has user_id, tries, readiness, pace and days_left (null without a
    date); ``stats`` and ``areas`` are those of the mastery operators.
    """
    state = users.select("user_id", "readiness", "days_left", (F.col("tries") < COLD).alias("cold"), F.coalesce(F.col("pace") == "behind", F.lit(False)).alias("behind"))
    state = state.withColumns({"weak_n": F.when(F.col("behind"), 3).otherwise(2), "cover_n": F.when(F.col("cold"), 0).when(F.col("behind"), 2).otherwise(1)})
    place = lambda *order: F.row_number().over(W.partitionBy("user_id").orderBy(*order))
    low = stats.filter(F.col("seen") & (F.col("mastery") < WEAK)).withColumn("nth", place(F.round("mastery", 9), "cluster", "area", "pi")).filter("nth <= 3")
    weak = low.join(state, "user_id").filter("nth <= weak_n")
    of_area = areas.select("user_id", "cluster", "area", F.when(F.col("seen") > 0, F.col("mastery")).otherwise(1.0).alias("of_area"))
    unseen = stats.filter("NOT seen").join(of_area, ["user_id", "cluster", "area"]).withColumn("nth", place(F.round("of_area", 9), "cluster", "area", "pi")).filter("nth <= 2")
    cover = unseen.join(state, "user_id").filter("nth <= cover_n")
    best = areas.filter("seen > 0").groupBy("user_id").agg(F.min_by("area", F.struct(-F.round("mastery", 9), "area")).alias("area"))
    ready = state.filter(~F.col("cold"))
    named = lambda kind: F.concat(F.lit(f"{kind}-"), "cluster", F.lit("/"), "pi")
    parts = [
        spec(state.filter("cold"), "warmup", 0),
        spec(weak, "weak-drill", 1, named("weak"), F.col("cluster"), F.col("area"), F.col("pi"), F.col("nth")),
        spec(cover, "coverage", 2, named("cover"), F.col("cluster"), F.col("area"), F.col("pi"), F.col("nth")),
        spec(ready.filter(F.col("readiness") >= CHALLENGE).join(best, "user_id", "left"), "challenge", 3, area=F.col("area")),
        spec(ready.filter((F.col("days_left") <= NEAR) | (F.col("readiness") >= MILESTONE)), "milestone", 4),
    ]
    return reduce(DataFrame.unionByName, parts)


def day_plan(fresh: DataFrame, custom: DataFrame, frozen: DataFrame, dismissed: DataFrame, available: DataFrame, quizzes: DataFrame, sessions: DataFrame, log: DataFrame, misses: DataFrame, bank_total: int, budget: int = BUDGET) -> DataFrame:
    """(user_id, place, task_id, type, pi, size, current, done, added): the user's own tasks, then recommended ones up to the budget.

    ``fresh`` is what :func:`recommended` gives; a user's ``frozen`` set, if it
    has a row, stands in its place for the day. ``custom`` and ``frozen`` are :data:`SPEC` with ``within``,
    their order. A task's size is that of its stored quiz (user_id, task_id, n),
    else what it asks for, but no more than ``available`` (cluster, pi, n) or the bank
    has; a task of size 0 is dropped. A batch of misses has its own ids: its
    size is their number, and those count as done that ``misses`` (user_id,
    question_id, resolved) doesn't hold open. Other progress is attempts in the task's own ``sessions`` (user_id, task_id,
    session_id) alone. Dismissed tasks (user_id, task_id) and those that an own task covers (the same
    type and indicator; batches by id) leave no gap to fill; own tasks take their part of the budget.
    """
    pinned = frozen.withColumns({"rule": F.lit(0)})
    rec = fresh.join(pinned.select("user_id").distinct(), "user_id", "left_anti").unionByName(pinned)
    tasks = rec.withColumn("added", F.lit(False)).unionByName(custom.withColumns({"rule": F.lit(-1), "added": F.lit(True)}))
    drill = F.col("type").isin("weak-drill", "coverage")
    quiz = F.col("type").isin("warmup", "challenge", "milestone")
    batch = F.col("type") == "fix-misses"

    tasks = tasks.join(available.withColumnRenamed("n", "_there"), ["cluster", "pi"], "left").join(quizzes.withColumnRenamed("n", "_stored"), ["user_id", "task_id"], "left")
    nominal = F.when(drill, F.least("size", "_there")).when(quiz, F.least("size", F.lit(bank_total))).otherwise(F.col("size"))
    total = F.when(batch, F.size(F.coalesce("miss_ids", F.array().cast("array<string>")))).when(F.col("_stored") > 0, F.col("_stored")).otherwise(nominal)
    tasks = tasks.withColumn("total", total).filter("total > 0")

    own_log = log.groupBy("user_id", "session_id").agg(F.count("*").alias("n"))
    answered = sessions.distinct().join(own_log, ["user_id", "session_id"]).groupBy("user_id", "task_id").agg(F.sum("n").alias("_answered"))
    open_ = misses.filter("NOT resolved").select("user_id", "question_id").distinct()
    asked = tasks.filter(batch).select("user_id", "task_id", F.explode("miss_ids").alias("question_id"))
    still = asked.join(open_, ["user_id", "question_id"], "left_semi").groupBy("user_id", "task_id").agg(F.count("*").alias("_open"))
    tasks = tasks.join(answered, ["user_id", "task_id"], "left").join(still, ["user_id", "task_id"], "left")
    current = F.when(batch, F.col("total") - F.coalesce("_open", F.lit(0))).otherwise(F.least(F.coalesce("_answered", F.lit(0)), F.col("total")))

    key = F.when(batch, F.col("task_id")).when(F.col("pi").isNotNull(), F.concat_ws(":", "type", "cluster", "pi")).otherwise(F.col("type"))
    covered = custom.select("user_id", key.alias("_key")).distinct()
    tasks = tasks.withColumn("_key", key)
    own = tasks.filter("added")
    kept = tasks.filter("NOT added").join(dismissed.distinct(), ["user_id", "task_id"], "left_anti").join(covered, ["user_id", "_key"], "left_anti")
    taken = own.groupBy("user_id").agg(F.count("*").alias("_own"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("rule", "within", "task_id"))
    kept = kept.withColumn("_nth", nth).join(taken, "user_id", "left").filter(F.col("_nth") <= budget - F.coalesce("_own", F.lit(0))).drop("_nth", "_own")
    rows = own.unionByName(kept).withColumn("current", current.cast("int"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("added"), "rule", "within", "task_id"))
    return rows.select("user_id", place.alias("place"), "task_id", "type", "pi", F.col("total").cast("int").alias("size"), "current", (F.col("current") >= F.col("total")).alias("done"), "added")
