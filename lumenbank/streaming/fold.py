"""Mastery as a fold over event time: attempts that may still be overtaken wait in state, settled ones are two sums."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lumenbank.operators.mastery import DECAY, FULL, PI, PRIOR, PRIOR_HITS, tier_weight

#: Stateful processors keep their state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}



@contextmanager
def stateful(session, partitions: int | None):
    """The session set for a stateful stream: its store, and how many partitions of state a new checkpoint gets (an old one keeps its own)."""
    wanted = STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: session.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        session.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            session.conf.set(k, v) if v is not None else session.conf.unset(k)


SETTLED = "s double, c double, n long"
WAITING = "ts timestamp, id long, w double, correct boolean"
OUT = "user_id long, cluster string, area string, pi string, n long, mastery double, coverage double, evidence double"


class MasteryFold(StatefulProcessor):
    """State of one indicator of one user.

    A newer attempt turns the sum S into w + 0.9 S, so sums can only grow at
    their newer end. Attempts beyond the watermark wait in a list, in which a
    late one finds its place in time; a timer folds what the watermark has
    passed into ``settled``, and nothing at or before it is let in again. The
    list holds the attempts of the watermark's delay, however long the log.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.waiting = handle.getListState("waiting", WAITING)

    @staticmethod
    def fold(sums: tuple[float, float, int], rows: list[tuple]) -> tuple[float, float, int]:
        """Sums after ``rows`` (ts, id, w, correct) from the oldest to the newest; of equal times the smaller id is the newer."""
        s, c, n = sums
        for _, _, w, right in sorted(rows, key=lambda r: (r[0], -r[1])):
            s, c, n = w + DECAY * s, w * right + DECAY * c, n + 1
        return s, c, n

    def held(self) -> tuple[tuple[float, float, int], list[tuple]]:
        return tuple(self.settled.get()) if self.settled.exists() else (0.0, 0.0, 0), [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums, waiting = self.held()
        known = {r[1]: r for r in waiting}
        for frame in rows:
            for r in zip(*(frame[c] for c in ("ts", "id", "w", "correct"))):
                known.setdefault(r[1], (r[0].to_pydatetime(), int(r[1]), float(r[2]), bool(r[3])))  # a repeated id is the same attempt
        if len(known) > len(waiting):
            waiting = sorted(known.values())
            self.waiting.put(waiting)
            self.handle.registerTimer(int(waiting[-1][0].timestamp() * 1000) + 1)
            s, c, n = self.fold(sums, waiting)
            yield pd.DataFrame([(*key, n, (PRIOR_HITS + c) / (PRIOR + s), min(1.0, s / FULL), s)], columns=[*PI, "n", "mastery", "coverage", "evidence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sums, waiting = self.held()
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        done = [r for r in waiting if r[0].timestamp() <= passed]
        if done:
            self.settled.update(self.fold(sums, done))
            left = [r for r in waiting if r[0].timestamp() > passed]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


def running(stream: DataFrame, delay: str) -> DataFrame:
    """Each indicator's mastery after each batch that brings it a new attempt, for attempts that are late by ``delay`` at most."""
    rows = stream.select(*PI, "id", F.col("ts").cast("timestamp").alias("ts"), tier_weight().alias("w"), "correct").withWatermark("ts", delay)
    return rows.groupBy(*PI).transformWithStateInPandas(MasteryFold(), OUT, "Update", "EventTime")


def advance(stream: DataFrame, state: str, checkpoint: str, delay: str, partitions: int | None = None) -> int:
    """Folds what has arrived since the last call and returns the number of batches; each batch's rows replace what an earlier try of it wrote."""
    with stateful(stream.sparkSession, partitions):
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{state}/batch={number}")
        run = running(stream, delay).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        return sum(p["numInputRows"] > 0 for p in run.recentProgress)


def latest(states: DataFrame) -> DataFrame:
    """The newest state of each indicator from the batches that :func:`advance` has written."""
    values = ["n", "mastery", "coverage", "evidence"]
    return states.groupBy(*PI).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*PI, "x.*")
