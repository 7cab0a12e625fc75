"""Streams over many micro-batches against the batch result and plain loops."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenbank.operators import mastery as M
from lumenbank.sources.snapshots import Snapshots
from lumenbank.streaming import fold, outbox

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def written(spark, place, batches, schema):
    """One file a batch, in order, as a stream that takes a file a time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)


LOG = "user_id long, cluster string, area string, pi string, id long, ts timestamp, difficulty string, correct boolean"


def attempts(n, seed):
    draw = random.Random(seed)
    return [(draw.randrange(3), "c", "a", f"p{draw.randrange(4)}", i, START + timedelta(minutes=draw.choice([i, i, i // 2 * 2])), draw.choice(["easy", "medium", "hard"]), draw.random() < 0.6) for i in range(n)]


def test_fold_of_late_and_repeated_attempts(spark, tmp_path):
    """Seven batches, attempts up to 40 minutes late and some sent twice: the batch result; a second run adds nothing."""
    rows = attempts(420, 1)
    arrival = sorted(rows, key=lambda r: (r[5] + timedelta(minutes=random.Random(r[4]).randrange(40)), r[4]))
    batches = [arrival[k : k + 60] for k in range(0, 420, 60)]
    for k in range(1, 7):
        batches[k] = batches[k] + batches[k][::9] + [r for r in batches[k - 1] if r[5] > max(x[5] for x in batches[k - 1]) - timedelta(minutes=10)]
    stream = written(spark, f"{tmp_path}/in", batches[:5], LOG)
    assert fold.advance(stream, f"{tmp_path}/state", f"{tmp_path}/log", "2 hours") == 5
    for b in batches[5:]:  # goes on from the checkpoint
        spark.createDataFrame(b, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert fold.advance(stream, f"{tmp_path}/state", f"{tmp_path}/log", "2 hours") == 2
    columns = ["user_id", "pi", "n", F.round("mastery", 9), F.round("coverage", 9), F.round("evidence", 9)]
    got = fold.latest(spark.read.parquet(f"{tmp_path}/state")).select(*columns)
    want = M.pi_stats(spark.createDataFrame(rows, LOG)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state").collect()), key=repr)
    assert fold.advance(stream, f"{tmp_path}/state", f"{tmp_path}/log", "2 hours") == 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state").collect()), key=repr) == before


def test_settled_attempts_leave_the_list(spark, tmp_path):
    """What the watermark has passed is two sums, and still the batch result holds."""
    rows = sorted(attempts(300, 5), key=lambda r: r[5])
    stream = written(spark, f"{tmp_path}/in", [rows[k : k + 50] for k in range(0, 300, 50)], LOG)
    fold.advance(stream, f"{tmp_path}/state", f"{tmp_path}/log", "1 minute")
    reader = spark.read.format("statestore").option("path", f"{tmp_path}/log")
    waiting = reader.option("stateVarName", "waiting").load()
    settled = spark.read.format("statestore").option("path", f"{tmp_path}/log").option("stateVarName", "settled").load().selectExpr("sum(value.n)").first()[0]
    lists = waiting.selectExpr("sum(size(list_value))").first()[0] if "list_value" in waiting.columns else waiting.count()
    assert settled + lists == 300 and lists < 60
    got = fold.latest(spark.read.parquet(f"{tmp_path}/state")).select("user_id", "pi", "n", F.round("mastery", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.pi_stats(spark.createDataFrame(rows, LOG)).select("user_id", "pi", "n", F.round("mastery", 9)).collect()))


OPS = "user_id long, seq long, op string, payload string, at timestamp"


def remote():
    """The remote of these tests: what becomes of an entry depends on it and on the tries so far."""

    def deliver(user, seq, op, payload, tries):
        if seq % 13 == 0:
            return "permanent"
        if seq == 33:
            return "unknown"
        if seq % 7 == 0 and tries < 2:
            return "transient"
        if seq % 25 == 0 and tries < 7:
            return "unknown"
        return None

    return deliver


def plain_queue(rows):
    """What becomes of every entry, by a loop over each user's queue."""
    out, place, deliver = {}, defaultdict(int), remote()
    for user, seq, op, payload, _ in sorted(set(rows), key=lambda r: (r[0], r[1])):
        tries = 0
        while True:
            failure, tries = deliver(user, seq, op, payload, tries), tries + 1
            if failure is None:
                place[user] += 1
                out[user, seq] = ("sent", tries, place[user])
            elif failure == "permanent" or failure == "unknown" and tries >= 8:
                out[user, seq] = ("dead", tries, None)
            else:
                continue
            break
    return out


def ops(n):
    draw = random.Random(3)
    return [(s % 4, s, "reset" if s == 38 else "attempts", json.dumps({"id": s % 17, "v": draw.random()}), START + timedelta(seconds=s)) for s in range(n)]


def test_outbox_in_order(spark, tmp_path):
    """Entries behind a failing head wait; tries are counted by failures; dead ones leave the queue; ticks move the clock of retries."""
    rows = ops(72)
    ticks = [[(u, -1, "tick", None, START + timedelta(hours=k)) for u in range(4)] for k in range(1, 26)]
    place = f"{tmp_path}/in"
    stream = written(spark, place, [rows[:40] + rows[3:20], rows[40:60], rows[60:]] + ticks[:1], OPS)
    go = lambda: outbox.drain(stream, remote(), f"{tmp_path}/sent", f"{tmp_path}/dead", f"{tmp_path}/log")
    go()
    partly = {(r.user_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/sent").collect()}
    want = plain_queue(rows)
    # So far each user's delivered entries are the first ones of its queue.
    for user in range(4):
        done = [s for (u, s), x in sorted(want.items()) if u == user and x[0] == "sent"]
        assert [s for s in done if (user, s) in partly] == done[: sum(u == user for u, _ in partly)]
    assert len(partly) < sum(x[0] == "sent" for x in want.values())
    for tick in ticks[1:]:
        spark.createDataFrame(tick, OPS).coalesce(1).write.mode("append").parquet(place)
    go()
    sent, dead = spark.read.parquet(f"{tmp_path}/sent"), spark.read.parquet(f"{tmp_path}/dead")
    got = {(r.user_id, r.seq): ("sent", r.tries, r.place) for r in sent.collect()} | {(r.user_id, r.seq): ("dead", r.tries, None) for r in dead.collect()}
    assert got == want and sent.count() + dead.count() == len(want)
    assert go() == 0 and sent.count() + dead.count() == len(want)
    # The remote: the newest delivered write of each id after the reset.
    held = {}
    for user, seq, op, payload, _ in rows:
        if want[user, seq][0] == "sent":
            if op == "reset":
                held = {k: v for k, v in held.items() if k[0] != user}
            else:
                held[user, json.loads(payload)["id"]] = payload
    assert {(r.user_id, r.id): r.payload for r in outbox.remote_rows(sent).collect()} == held


def test_batches_of_several_files(spark, tmp_path):
    """A batch's files come together and batches in their order."""
    from lumenbank.plans import streams

    place, seen = f"{tmp_path}/in", []
    stream = streams.arriving(spark.range(3000), place, F.floor(F.col("id") / 1000), 3, files=4)
    stream.writeStream.foreachBatch(lambda batch, n: seen.append(batch.agg(F.min("id"), F.max("id"), F.count("*")).first())).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in seen] == [(0, 999, 1000), (1000, 1999, 1000), (2000, 2999, 1000)]
    assert len(list(tmp_path.glob("in/*.parquet"))) == 12


def test_a_timer_catches_up(spark, tmp_path):
    """One tick of many hours makes all tries that fall due by then, each after its wait: what a tick for each try gives, in few batches."""
    rows = ops(72)
    ticks = [[(0, -1, "tick", None, START + timedelta(hours=k))] for k in (30, 60)]
    stream = written(spark, f"{tmp_path}/in", [rows[:40] + rows[3:20], rows[40:]] + ticks, OPS)
    outbox.drain(stream, remote(), f"{tmp_path}/sent", f"{tmp_path}/dead", f"{tmp_path}/log", 2, catch_up=True)
    sent, dead = spark.read.parquet(f"{tmp_path}/sent"), spark.read.parquet(f"{tmp_path}/dead")
    got = {(r.user_id, r.seq): ("sent", r.tries, r.place) for r in sent.collect()} | {(r.user_id, r.seq): ("dead", r.tries, None) for r in dead.collect()}
    assert got == plain_queue(rows) and sent.count() + dead.count() == len(got)


def test_tries_wait_until_their_time():
    """A clock that has not passed a wait leaves the queue standing with a timer at its end."""
    box, timers, kept = outbox.Outbox(lambda *x: outbox.TRANSIENT if x[4] < 6 else None, catch_up=True), [], []
    box.handle = type("H", (), {"registerTimer": staticmethod(timers.append)})
    box.keep = lambda sent, entries: kept.append((sent, entries))
    assert list(box.drain((1,), 4, [(7, "a", "x", 0), (8, "b", "y", 0)], 1000, 20_000)) == []
    assert timers == [31_000] and kept == [(4, [(7, "a", "x", 4), (8, "b", "y", 0)])]
    out = list(box.drain((1,), 4, [(7, "a", "x", 4), (8, "b", "y", 5)], 31_000, 100_000))
    assert [(r.seq, r.tries, r.place) for r in out] == [(7, 7, 5)] and timers[1:] == [121_000] and kept[1] == (5, [(8, "b", "y", 6)])


def test_flush_pulls_and_keeps_what_it_has(spark, tmp_path):
    """Rounds go on while writes arrive; a pull that fails while its rows are written leaves the old snapshot; the next one is whole."""
    local = Snapshots(spark, f"{tmp_path}/local")
    rows = lambda *ids: spark.createDataFrame([(1, i, "attempts", str(v), v) for i, v in ids], "user_id long, id long, op string, payload string, seq long")
    reads = iter([5, 2, 0])
    assert outbox.flush(lambda: next(reads), lambda: rows((1, 10), (2, 20)), local) == (3, None)
    assert sorted((r.id, r.seq) for r in local.read().collect()) == [(1, 10), (2, 20)]
    versions = local.versions()

    def broken():
        return rows((3, 30)).withColumn("payload", F.raise_error(F.lit("gone")).cast("string"))

    rounds, failure = outbox.flush(lambda: 0, broken, local)
    assert rounds == 1 and failure and local.versions() == versions
    assert sorted((r.id, r.seq) for r in local.read().collect()) == [(1, 10), (2, 20)]
    assert outbox.flush(lambda: 0, lambda: rows((2, 21), (3, 30)), local) == (1, None)
    assert sorted((r.id, r.seq) for r in local.read().collect()) == [(1, 10), (2, 21), (3, 30)]
    assert sorted((r.id, r.seq) for r in local.read(versions[0]).collect()) == [(1, 10), (2, 20)]


def test_one_writer_publishes_a_version(spark, tmp_path, monkeypatch):
    one, other = Snapshots(spark, f"{tmp_path}/t"), Snapshots(spark, f"{tmp_path}/t")
    one.publish(spark.range(3))
    monkeypatch.setattr(other, "versions", lambda: [])  # saw the folder before the first one published
    with pytest.raises(RuntimeError):
        other.publish(spark.range(9))
    monkeypatch.undo()
    assert other.read().count() == 3 and other.versions() == [1]
