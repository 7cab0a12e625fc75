"""The outbox: each user's writes reach the remote table in order, with retries by timer and a quarantine for what never will; then a pull."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lumenbank.sources.snapshots import Snapshots
from lumenbank.streaming.fold import stateful

# Tries after which an unexplained failure is given up, and the waits between tries in seconds.
MOST_TRIES, FIRST_WAIT, LONGEST_WAIT = 8, 1, 30

#: What a delivery says of its failure; None means delivered.
PERMANENT, TRANSIENT, UNKNOWN = "permanent", "transient", "unknown"

#: State of a user: how much was delivered, and the queue by columns; one value, as each call of the state is a message to the JVM.
QUEUE = "sent long, seqs array<long>, ops array<string>, payloads array<string>, tries array<int>"
OUT = "user_id long, seq long, op string, payload string, status string, tries int, place long"
TICK = "tick"

#: A row of the output.
Sent = Row(*[c.split()[0] for c in OUT.split(", ")])


class Outbox(StatefulProcessor):
    """The queue of one user, oldest first.

    Entries are delivered in order. A transient failure, or an unknown one
    below ``MOST_TRIES``, counts a try, stops the queue and sets a timer; a
    permanent one, or the last unknown one, takes the entry out as dead, and
    the next one follows. ``deliver(user, seq, op, payload, tries)`` is called
    with the tries so far and has to be idempotent: a batch that is run again
    starts from the state before it and delivers the same entries again, as
    does a row repeated after its entry has left the queue. ``place`` counts what was delivered to a user.

    A timer that the stream's time has passed is one try. With ``catch_up`` it
    is all the tries whose times have passed by then, each its wait after the
    one before, so a replayed log or a clock that goes by hours needs no batch for each try.
    """

    def __init__(self, deliver: Callable[[int, int, str, str, int], str | None], catch_up: bool = False):
        self.deliver, self.catch_up = deliver, catch_up

    def init(self, handle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", QUEUE)

    def held(self) -> tuple[int, list[tuple]]:
        """How much was delivered, and the entries (seq, op, payload, tries) that wait."""
        value = self.queue.get()
        return (value[0], list(zip(*value[1:]))) if value else (0, [])

    def keep(self, sent: int, entries: list[tuple]) -> None:
        self.queue.update((sent, *(map(list, zip(*entries)) if entries else ([], [], [], []))))

    def drain(self, key, sent: int, entries: list[tuple], now: int, until: int) -> Iterator[Row]:
        """Delivers from the time ``now`` on, with tries that fall due up to ``until``."""
        done = 0
        while done < len(entries):
            seq, op, payload, tries = entries[done]
            failure, tries = self.deliver(key[0], seq, op, payload, tries), tries + 1
            if failure == TRANSIENT or failure == UNKNOWN and tries < MOST_TRIES:
                entries[done] = (seq, op, payload, tries)
                now += 1000 * min(LONGEST_WAIT, FIRST_WAIT * 2 ** min(tries, 5))
                if now <= until:
                    continue
                self.handle.registerTimer(now)
                break
            done += 1
            sent += failure is None
            yield Sent(key[0], seq, op, payload, "sent" if failure is None else "dead", tries, sent if failure is None else None)
        self.keep(sent, entries[done:])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sent, waiting = self.held()
        entries = {e[0]: e for e in waiting}
        for _, seq, op, payload, *_ in rows:
            if op != TICK:
                entries.setdefault(seq, (seq, op, payload, 0))  # a number that waits already is the same write
        in_order = sorted(entries.values(), key=lambda e: e[0])
        if waiting:
            # The head waits for its timer, and all else for the head.
            self.keep(sent, in_order)
        elif in_order:
            now = timerValues.getCurrentWatermarkInMs()
            yield from self.drain(key, sent, in_order, now, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sent, entries = self.held()
        if entries:
            until = timerValues.getCurrentWatermarkInMs()
            yield from self.drain(key, sent, entries, expiredTimerInfo.getExpiryTimeInMs() if self.catch_up else until, until)

    def close(self) -> None:
        pass


def drain(ops: DataFrame, deliver, sent: str, quarantine: str, checkpoint: str, partitions: int | None = None, catch_up: bool = False) -> int:
    """Delivers what waits in a stream of (user_id, seq, op, payload, at), as far as it goes, and returns the rows read.

    The clock of retries is the stream's own time ``at``; a row with the op
    ``tick`` moves it and writes nothing. Delivered entries go to ``sent`` and
    dead ones to ``quarantine``, a folder for each batch that a second try of the batch writes anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Computed once: a second pass over the batch would call the remote again.
        held = batch.persist()
        try:
            for status, place in (("sent", sent), ("dead", quarantine)):
                held.filter(F.col("status") == status).drop("status").write.mode("overwrite").parquet(f"{place}/batch={number}")
        finally:
            held.unpersist()

    with stateful(ops.sparkSession, partitions):
        rows = ops.select("user_id", "seq", "op", "payload", "at").withWatermark("at", "0 seconds")
        out = rows.groupBy("user_id").transformWithState(Outbox(deliver, catch_up), OUT, "Update", "EventTime")
        run = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        return sum(p["numInputRows"] for p in run.recentProgress)


def remote_rows(sent: DataFrame) -> DataFrame:
    """The remote table that delivered entries make: for each user and id (in the payload) the newest write after the user's last reset."""
    newest = F.max(F.when(F.col("op") == "reset", F.col("seq"))).over(W.partitionBy("user_id"))
    rows = sent.withColumn("cleared", newest).filter((F.col("op") != "reset") & (F.col("cleared").isNull() | (F.col("seq") > F.col("cleared"))))
    rows = rows.withColumn("id", F.get_json_object("payload", "$.id").cast("long"))
    return rows.groupBy("user_id", "id").agg(F.max_by(F.struct("op", "payload", "seq"), "seq").alias("x")).select("user_id", "id", "x.*")


def merged(local: DataFrame | None, remote: DataFrame) -> DataFrame:
    """Local rows with the remote ones put over them by user and id."""
    if local is None:
        return remote
    both = local.withColumn("_newer", F.lit(0)).unionByName(remote.withColumn("_newer", F.lit(1)))
    values = [c for c in local.columns if c not in ("user_id", "id")]
    return both.groupBy("user_id", "id").agg(F.max_by(F.struct(*values), "_newer").alias("x")).select("user_id", "id", "x.*")


def flush(send: Callable[[], int], pull: Callable[[], DataFrame], local: Snapshots, most: int = 100) -> tuple[int, str | None]:
    """Drains, pulls, and again while writes arrive meanwhile; returns the rounds and what the pull failed with.

    ``send`` drains and returns the rows read; a round that reads none ends the
    loop. A pull that fails, also halfway through its rows, leaves the local
    snapshot as it was: a new version is published only when it is written whole.
    """
    rounds, failure = 0, None
    while rounds < most:
        read = send()
        rounds += 1
        try:
            local.publish(merged(local.read(), pull()))
            failure = None
        except Exception as error:  # the remote may be away; the next flush tries again
            failure = f"{type(error).__name__}: {error}"
        if not read:
            break
    return rounds, failure
