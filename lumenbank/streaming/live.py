"""Attempts as a stream: deduplicated log, windowed counts, idempotent upserts and running mastery."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbank.operators.mastery import DECAY, FULL, PRIOR, PRIOR_HITS, tier_weight


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder; a local one only in a local session without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    return f"{base.rstrip('/')}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}" if base else tempfile.mkdtemp(prefix="spark-")


def run_once(stream: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Drains what is there into Parquet, exactly once by the file sink's log."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()


def upsert_once(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drains the stream through an idempotent batch function: a repeated batch id writes the same rows again."""
    stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First copy of each id that arrives within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def windowed(stream: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Attempts and right answers by cluster in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", delay).groupBy(window.alias("w"), "cluster").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


def session_windows(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """A user's attempts without a pause as long as the gap."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


STATE = "s double, c double, n long"
OUT = "user_id long, cluster string, area string, pi string, n long, mastery double, coverage double"


def running_mastery(stream: DataFrame) -> DataFrame:
    """Each indicator's mastery after each batch, from two sums: a newer attempt turns S into w + 0.9 S.

    Attempts of a batch are folded in time order; one that comes after a later
    batch's is folded where it arrives.
    """

    def fold(key, frames, state):
        s, c, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(frames).sort_values(["ts", "id"], ascending=[True, False])
        for w, right in zip(rows["w"], rows["correct"]):
            s, c, n = w + DECAY * s, w * right + DECAY * c, n + 1
        state.update((s, c, n))
        yield pd.DataFrame([(*key, n, (PRIOR_HITS + c) / (PRIOR + s), min(1.0, s / FULL))], columns=["user_id", "cluster", "area", "pi", "n", "mastery", "coverage"])

    rows = stream.select("user_id", "cluster", "area", "pi", "id", "ts", "correct", tier_weight().alias("w"))
    return rows.groupBy("user_id", "cluster", "area", "pi").applyInPandasWithState(fold, OUT, STATE, "update", "NoTimeout")
