"""Picks from a pool that turn away from what was picked before."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators.ranks import placed
from lumenbank.sources.storage import saved


def start_of(key: str, size: int) -> int:
    """Where a key's turn through the pool begins: the first 64 bits of its SHA-256, modulo the size."""
    return int(hashlib.sha256(key.encode()).hexdigest()[:16], 16) % size


def fresh_picks(rows: DataFrame, keys: list[str], order: list, seed: str, pool: list[str]) -> DataFrame:
    """Adds ``pick`` and ``place``: from its start on, the first value that no earlier row of the key has, or else the one that the fewest have.

    As the least used is always taken, each value has been used equally often
    after every len(pool) rows of a key. So a key's rows fall into blocks of
    that length that don't depend on each other: any key is spread over as
    many tasks as it has blocks, and a group has at most as many rows as the pool values.
    """
    n = len(pool)
    blocks = placed(rows, keys, order).withColumn("_block", F.floor(F.col("place") / n)).drop("size")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", pick string"

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame, left, out = frame.sort_values("place"), set(pool), []
        for key in frame[seed]:
            at = start_of(key, n)
            out.append(next(pool[(at + k) % n] for k in range(n) if pool[(at + k) % n] in left))
            left.discard(out[-1])
        return frame.assign(pick=out)

    return blocks.groupBy(*keys, "_block").applyInPandas(fold, schema).drop("_block")


def recent_picks(rows: DataFrame, keys: list[str], order: list, seed: str, pool: list[str], memory: int, block: int = 1024) -> DataFrame:
    """Adds ``pick`` and ``place``: from its start on, the first value that none of the key's last ``memory`` rows has, else the one at the start.

    Here each pick hangs on those before it. A key is cut into blocks; each is
    folded from what the block before it ended with in the last round, until no
    block's end changes: the first block is right at once, the k-th after k
    rounds at most, and mostly much sooner, since a pick forgets what is longer ago than ``memory``.
    """
    n = len(pool)
    cut = saved(placed(rows, keys, order).withColumn("_block", F.floor(F.col("place") / block)).drop("size"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema]
    before = saved(cut.select(*keys, "_block").distinct().withColumn("_before", F.array().cast("array<string>")))
    schema = ", ".join([*fields, "_before array<string>", "pick string"])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("place"), []
        held = list(frame["_before"].iloc[0])
        for key in frame[seed]:
            at, used = start_of(key, n), set(held[-memory:]) if memory else set()
            out.append(next((pool[(at + k) % n] for k in range(n) if pool[(at + k) % n] not in used), pool[at]))
            held = [*held, out[-1]][-memory:] if memory else []
        return frame.assign(pick=out)

    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in [*keys, "_block"]]
    while True:
        given = cut.join(before, on=_all(same(cut, before))).select(*[cut[c] for c in cut.columns], "_before")
        picked = saved(given.groupBy(*keys, "_block").applyInPandas(fold, schema))
        # What each block ends with, with what it began with where it is shorter than the memory.
        ends = picked.groupBy(*keys, "_block").agg(F.first("_before").alias("_given"), F.transform(F.array_sort(F.collect_list(F.struct("place", "pick"))), lambda x: x["pick"]).alias("_own"))
        tail = F.concat("_given", "_own")
        last = F.slice(tail, F.greatest(F.lit(1), F.size(tail) - memory + 1), F.lit(max(memory, 1))) if memory else F.array().cast("array<string>")
        next_before = F.coalesce(F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")), F.array().cast("array<string>"))
        ends = saved(ends.withColumn("_last", last).select(*keys, "_block", "_given", next_before.alias("_before")))
        if not ends.filter("_given <> _before").limit(1).count():
            return picked.drop("_block", "_before")
        before = ends.drop("_given")


def _all(tests):
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
