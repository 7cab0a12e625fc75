"""Places over ranges of (key, order) against plain sorting, with a key that holds most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenbank.operators import ranks


def rows_of(n):
    draw = random.Random(1)
    return [(draw.choice(["hot"] * 8 + ["a", "b", None]), draw.choice([None, *range(50)]), i) for i in range(n)]


def plain(rows):
    groups = defaultdict(list)
    for key, v, i in rows:
        groups[key].append((v is not None, v or 0, i))
    return {i: (place, len(g)) for g in groups.values() for place, (_, _, i) in enumerate(sorted(g))}


@pytest.mark.parametrize("few", [0, 100_000])
def test_places(spark, monkeypatch, few):
    """Nulls are a key and come first, whether the runs' counts are broadcast or joined."""
    monkeypatch.setattr(ranks, "FEW", few)
    rows = rows_of(600)
    frame = spark.createDataFrame(rows, "key string, v int, id long").repartition(6)
    got = ranks.placed(frame, ["key"], [F.col("v").asc_nulls_first(), F.col("id")])
    assert {r.id: (r.place, r.size) for r in got.collect()} == plain(rows) and got.columns == ["key", "v", "id", "place", "size"]
    down = ranks.numbered(frame, [], [F.col("id").desc()]).collect()
    assert {r.id: r.place for r in down} == {i: 600 - i for _, _, i in rows}
    assert ranks.placed(frame.limit(0), ["key"], [F.col("id")]).count() == 0


def test_a_hot_key_is_spread(spark):
    """No partition holds a key of most rows, and rows equal in key and order are split too."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for value in (F.col("id"), F.lit(1)):
            frame = spark.range(4_000).select(F.lit("hot").alias("key"), value.alias("v"), "id")
            got = ranks.placed(frame, ["key"], [F.col("v")])
            sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
            assert len(sizes) == 4 and max(sizes) < 2_000
            assert sorted(r.place for r in got.collect()) == list(range(4_000))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("n", [1, 3, 7])
def test_tiles(spark, n):
    for size in (1, 2, 6, 7, 20):
        got = spark.range(size).select(F.col("id").alias("place"), F.lit(size).cast("long").alias("size")).select(ranks.tiles(n).alias("t")).collect()
        q, r = divmod(size, n)
        assert [x.t for x in got] == [t + 1 for t in range(n) for _ in range(q + (t < r))]
