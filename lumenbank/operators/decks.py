"""Decks that draw in turn from shared lists: each goes on where the decks before it stopped, computed for all decks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators.ranks import placed
from lumenbank.sources.storage import saved

# Cards of a deck, and rows of the first tier before one of the second.
CAP, EVERY = 250, 3


def spread_by_tier(terms: DataFrame) -> DataFrame:
    """Terms (area, id, slug, difficulty) with ``pos`` from 0 and ``size`` in their area: tiers are spread evenly through it."""
    rows = placed(terms.select("area", "id", "slug", "difficulty"), ["area", "difficulty"], [F.col("id")], "nth", "of_tier")
    at = F.round((F.col("nth") + 0.5) / F.col("of_tier"), 9)
    return placed(rows.withColumn("at", at), ["area"], [F.col("at"), F.col("difficulty"), F.col("id")], "pos", "size").select("area", "id", "slug", "pos", "size")


def draws(terms: DataFrame, decks: DataFrame, cursors: DataFrame, depth: int, cap: int, every: int) -> DataFrame:
    """What each deck draws from the first ``depth`` rows of its lists from its cursors on, with what it had kept ``before`` each row.

    A tier's lists take turns; after ``every`` rows of tier 2 comes one of tier
    3, and what one tier has left follows when the other is used up.
    """
    wanted = decks.join(cursors, ["deck", "area"]).withColumn("r", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(depth)) - 1)))
    wanted = wanted.withColumn("pos", (F.col("cursor") + F.col("r")) % F.col("size")).drop("size")
    rows = wanted.join(terms.select("area", "pos", "id", "slug"), ["area", "pos"])
    turn = F.row_number().over(W.partitionBy("deck", "tier").orderBy("r", "area_order")) - 1
    group = F.when(F.col("tier") == 2, F.floor(F.col("turn") / every)).otherwise(F.col("turn"))
    in_deck = W.partitionBy("deck").orderBy("group", "tier", "turn")
    rows = rows.withColumn("turn", turn).withColumn("group", group).withColumn("draw", F.row_number().over(in_deck))
    first = F.row_number().over(W.partitionBy("deck", "slug").orderBy("draw")) == 1
    before = F.coalesce(F.sum(F.col("fresh").cast("int")).over(W.partitionBy("deck").orderBy("draw").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("fresh", first).withColumn("before", before).filter(F.col("before") < cap)


def compose(terms: DataFrame, decks: DataFrame, cap: int = CAP, every: int = EVERY) -> DataFrame:
    """(deck, place, id, slug, area): decks in their order, each from where the earlier ones have left their shared lists.

    ``terms`` are those of :func:`spread_by_tier`; ``decks`` has (deck,
    deck_order, area, tier, area_order). A deck keeps a slug once, up to
    ``cap`` cards, and moves an area's cursor by every row it has reached of it,
    repeats included. So a deck is a function of its cursors, and they are the
    running sums of what the decks before it reach. All decks are computed at
    once from guessed cursors, the sums are taken anew, and again until nothing
    changes: the first deck is right at once, the k-th after k rounds at most,
    and as only repeated slugs change what a deck reaches, mostly after two or
    three. An area without terms gives nothing.
    """
    sizes = terms.select("area", "size").distinct()
    known = saved(decks.join(sizes, "area"))
    cursors, depth = saved(known.select("deck", "area", F.lit(0).cast("long").alias("cursor"))), cap + 1
    while True:
        found = saved(draws(terms, known, cursors, depth, cap, every))
        used = found.groupBy("deck", "tier", "area").agg(F.count("*").alias("n"))
        per_tier = known.join(used, ["deck", "tier", "area"], "left").groupBy("deck", "tier").agg(F.sum("n").alias("reached"), F.sum(F.least("size", F.lit(depth))).alias("there"), F.max("size").alias("longest"))
        # A list that was cut short must not have been read to its end.
        if per_tier.filter((F.col("longest") > depth) & (F.col("reached") >= F.col("there"))).limit(1).count():
            depth *= 2
            continue
        earlier = W.partitionBy("area").orderBy("deck_order").rowsBetween(W.unboundedPreceding, -1)
        reached = known.join(used, ["deck", "tier", "area"], "left").select("deck", "area", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cursor"))
        reached = saved(reached)
        changed = reached.join(cursors.withColumnRenamed("cursor", "old"), ["deck", "area"]).filter("cursor <> old").limit(1).count()
        cursors = reached
        if not changed:
            return found.filter("fresh").select("deck", (F.col("before") + 1).alias("place"), "id", "slug", "area")
