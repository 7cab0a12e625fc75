"""Queries on streams of many micro-batches: mastery folded over event time, the outbox, and the flush that pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbank.plans.progress import STATS, rounded
from lumenbank.sources.adapters import attempts, table
from lumenbank.sources.snapshots import Snapshots
from lumenbank.streaming import fold, live, outbox

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def arriving(rows: DataFrame, place: str, by: F.Column, batches: int, files: int = 1) -> DataFrame:
    """``rows`` as a stream of batches, one for each of ``by``'s values from 0, written in that order as so many files each; with several, each value needs many times as many rows."""
    schema = rows.schema
    for k in range(batches):
        batch = rows.filter(by == k)
        (batch.repartition(files) if files > 1 else batch.coalesce(1)).write.mode("append").parquet(place)
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(place)


@query("stm05_event_time_fold", f"{STATS} SELECT user_id, cluster, area, pi, round(mastery, 6) AS mastery, round(coverage, 6) AS coverage, round(evidence, 6) AS evidence, n FROM stats")
def event_time_fold(spark, sf):
    """The attempt log in six batches by day, each eighth attempt five days late and each tenth sent twice: the batch result."""
    place = live.scratch(spark)
    day = F.datediff("ts", F.lit("2024-01-01")) + F.when(F.col("id") % 8 == 0, 5).otherwise(0)
    log = attempts(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "part": F.least(F.lit(5), F.floor(day / 5)).cast("int")})
    twice = log.filter("id % 10 = 0").withColumn("part", F.least(F.lit(5), F.col("part") + 1))
    stream = arriving(log.unionByName(twice), f"{place}/in", F.col("part"), 6)
    # Rows of a batch span five days, and late ones five more; a repeated one comes up to ten later.
    fold.advance(stream, f"{place}/state", f"{place}/log", "20 days", tasks(log.count()))
    return rounded(fold.latest(spark.read.parquet(f"{place}/state")), "mastery", "coverage", "evidence")


def tasks(rows: int) -> int:
    """Partitions of a stream's state: one for each 50,000 rows, four at least."""
    return max(4, rows // 50_000)


def ops(spark, sf):
    """Each event as a write of its user: a reset, or a row whose id is a digit."""
    e = table(spark, sf, "events")
    op = F.when(F.col("event_id") % 173 == 0, "reset").otherwise(F.col("event_type"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id"))
    return e.select("user_id", F.col("event_id").alias("seq"), op.alias("op"), F.to_json(F.struct((F.col("event_id") % 7).alias("id"), F.col("event_type").alias("kind"))).alias("payload"), at.alias("at"))


def failing(permanent: int, unknown: int, transient: int):
    """A remote that refuses every so many writes: for good, without a reason, or twice."""

    def deliver(user, seq, op, payload, tries):
        if seq % permanent == 0:
            return outbox.PERMANENT
        if unknown and seq % unknown == 0:
            return outbox.UNKNOWN
        return outbox.TRANSIENT if seq % transient == 0 and tries < 2 else None

    return deliver


def drained(spark, sf, deliver):
    """The folders of a queue that has three batches of writes, and a function that drains it and moves the clock until nothing waits."""
    place, rows = live.scratch(spark), ops(spark, sf)
    last = rows.agg(F.max("seq")).first()[0]
    third = F.floor(F.col("seq") * 3 / (last + 1))
    counts = [r["count"] for r in rows.groupBy(third.alias("third")).count().collect()]
    # A file for each 250,000 rows, as one task writes a file and one reads it.
    files = max(1, min(counts) // 250_000) if len(counts) == 3 else 1
    stream = arriving(rows, f"{place}/in", third, 3, files)
    total, hour = sum(counts), 0
    size = lambda kind: spark.read.parquet(f"{place}/{kind}").count()

    def send() -> int:
        nonlocal hour
        read = outbox.drain(stream, deliver, f"{place}/sent", f"{place}/dead", f"{place}/log", tasks(total), catch_up=True)
        if size("sent") + size("dead") == total:
            return 0
        for hour in range(hour + 1, hour + 9):
            tick = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("seq"), F.lit(outbox.TICK).alias("op"), F.lit(None).cast("string").alias("payload"), F.timestamp_seconds(F.lit(1_700_000_000 + last + 3600 * hour)).alias("at"))
            tick.write.mode("append").parquet(f"{place}/in")
        return read + 8

    return place, send


OPS_SQL = "o AS (SELECT user_id, event_id AS seq, CASE WHEN event_id % 173 = 0 THEN 'reset' ELSE event_type END AS op, event_id % 7 AS id FROM events)"


@query("stm02_outbox_drain", f"""WITH {OPS_SQL}, s AS (
        SELECT *, CASE WHEN seq % 41 = 0 THEN 1 WHEN seq % 211 = 0 THEN 8 WHEN seq % 97 = 0 THEN 3 ELSE 1 END AS tries,
               CASE WHEN seq % 41 = 0 OR seq % 211 = 0 THEN 'dead' ELSE 'sent' END AS status FROM o)
    SELECT user_id, seq, op, status, tries, CASE WHEN status = 'sent' THEN count(*) FILTER (WHERE status = 'sent') OVER (PARTITION BY user_id ORDER BY seq) END AS place FROM s""")
def outbox_drain(spark, sf):
    """What becomes of every write: its tries are deliveries that failed and the last one, its place is the order in which its user's writes arrived."""
    place, send = drained(spark, sf, failing(41, 211, 97))
    while send():
        pass
    parts = [spark.read.parquet(f"{place}/{kind}").withColumn("status", F.lit(kind)) for kind in ("sent", "dead")]
    return parts[0].unionByName(parts[1]).select("user_id", "seq", "op", "status", "tries", "place")


@query("stm03_flush_pull", f"""WITH {OPS_SQL}, s AS (SELECT * FROM o WHERE seq % 41 <> 0),
    r AS (SELECT *, max(seq) FILTER (WHERE op = 'reset') OVER (PARTITION BY user_id) AS cleared FROM s)
    SELECT user_id, id, arg_max(op, seq) AS op, max(seq) AS seq FROM r WHERE op <> 'reset' AND (cleared IS NULL OR seq > cleared) GROUP BY user_id, id""")
def flush_pull(spark, sf):
    """The local rows after flushes whose first pull fails: the remote's newest row of each id since its user's last reset."""
    place, send = drained(spark, sf, failing(41, 0, 97))
    local, pulls = Snapshots(spark, f"{place}/local"), iter([OSError("the remote is away")])

    def pull():
        for failure in pulls:
            raise failure
        return outbox.remote_rows(spark.read.parquet(f"{place}/sent"))

    # Pulls merge by id and never take a row away, so the snapshot begins when the queue is empty.
    while send():
        pass
    for _ in range(2):
        outbox.flush(lambda: 0, pull, local)
    return local.read().select("user_id", "id", "op", "seq")
