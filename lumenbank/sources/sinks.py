"""Sinks as pure steps: what a target holds after a write. The caller writes the result, so a retry writes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First write wins: new keys only, and of a key repeated in ``rows`` the first by ``order``."""
    first = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(target.columns))


def upsert_latest(target: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: of each key the row with the highest version; rows beat the target at the same version."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.select(target.columns).withColumn("_new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select(target.columns)


def patch(target: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrites only what a patch supplies: ``set_<column>`` tells a supplied null from an absent value."""
    p = patches.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"set_{c}").alias(f"_set_{c}") for c in columns])
    joined = target.join(p, F.col(key) == F.col("_key"), "left")
    new = {c: F.when(F.coalesce(F.col(f"_set_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(target.columns)


def replace_and_retain(target: DataFrame, rows: DataFrame, keys: list[str], group: str, day: str, days: int) -> DataFrame:
    """Replaces rows of the same keys, then drops those over ``days`` before their group's newest day."""
    kept = target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(target.columns))
    newest = F.max(day).over(W.partitionBy(group))
    return kept.withColumn("_newest", newest).filter(F.col(day) >= F.date_sub("_newest", days)).drop("_newest")


def append_distinct(log: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends only rows whose key the log lacks."""
    return log.unionByName(rows.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti").select(log.columns))


def after_reset(operations: DataFrame, user: str, seq: str, kind: str) -> DataFrame:
    """Operations that no later reset of their user has wiped out."""
    last = F.max(F.when(F.col(kind) == "reset", F.col(seq))).over(W.partitionBy(user))
    return operations.withColumn("_reset", last).filter((F.col(kind) != "reset") & (F.col("_reset").isNull() | (F.col(seq) > F.col("_reset")))).drop("_reset")


def drift(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, state) of changed, missing and extra files by digest."""
    a, b = before.select(F.col(path).alias("a"), F.col(digest).alias("x")), after.select(F.col(path).alias("b"), F.col(digest).alias("y"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(path), state.alias("state")).filter("state IS NOT NULL")
