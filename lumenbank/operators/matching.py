"""The most similar other row by shared words: by shared subsets of few words, or from an inverted index read in blocks with bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators.ranks import counted, placed
from lumenbank.sources.storage import saved

#: Rows of a word's first block; each later block ends at four times as many.
FIRST = 16

#: Words of a set whose subsets are listed.
FEW_WORDS = 6


def block_of(place: Column) -> Column:
    """0 for the first 16 places, then 1 up to the 64th, 2 up to the 256th and so on."""
    return F.when(place < FIRST, 0).otherwise(F.floor((F.length(F.bin(F.floor(place / FIRST))) + 1) / 2)).cast("int")


def subsets(words: Column) -> Column:
    """All subsets, but the empty one, of a list that is not empty and has ``FEW_WORDS`` at most."""
    which = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(words)).cast("int") - 1)
    return F.transform(which, lambda k: F.filter(words, lambda w, i: F.getbit(k, i) == 1))


def least_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the two least ids of each key; a task sends no more than that."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).filter("_nth <= 2").drop("_nth")


def best_other(rows: DataFrame) -> DataFrame:
    """(shelf, id, other, score): of each row (shelf, id, words) the row of its shelf with the highest Jaccard similarity of words.

    Of equals the least id; null and 0.0 where no row shares a word, a row is
    alone on its shelf or has no words. Ids are unique in a shelf; words may repeat. The rows are read twice.

    Rows of equal words are one set: they find each other at 1, and others meet
    the least of them. Sets of a single row look for another set, on shelves
    whose sets have ``FEW_WORDS`` at most by the subsets that two sets share, elsewhere by blocks.
    """
    rows = rows.select("shelf", "id", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("words", F.array().cast("array<string>"))))).alias("words"))
    two = least_two(rows.filter(F.col("shelf").isNotNull() & (F.size("words") > 0)), ["shelf", "words"])
    # Where a set has one row, next is its own id.
    sets = saved(two.groupBy("shelf", "words").agg(F.min("id").alias("id"), F.max("id").alias("next")).withColumn("m", F.size("words")))
    most = counted(saved(sets.groupBy("shelf").agg((F.max("m") > F.lit(FEW_WORDS)).alias("wide"), (F.count_if(F.col("id") == F.col("next")) > 0).alias("asks"))))
    asked = saved(sets.join(most.filter("asks"), "shelf").drop("asks"))
    found = by_subsets(asked.filter("not wide"))
    if not asked.filter("wide").isEmpty():
        found = found.unionByName(by_blocks(asked.filter("wide")))
    sets = sets.withColumn("_copied", F.col("id") != F.col("next")).join(found, ["shelf", "id"], "left")
    sets = counted(saved(sets.select("shelf", "words", F.col("id").alias("_first"), "next", "_copied", "other", "score")))
    copied = F.col("_copied")
    other = F.when(copied, F.when(F.col("id") == F.col("_first"), F.col("next")).otherwise(F.col("_first"))).otherwise(F.col("other"))
    return rows.join(sets, ["shelf", "words"], "left").select("shelf", "id", other.alias("other"), F.when(copied, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def by_subsets(items: DataFrame) -> DataFrame:
    """(shelf, id, other, score) of the sets (shelf, words, id, next, m) whose ``next`` is their own id; sets that share no word are absent.

    Of a set's subsets, those that another set of m words has too tell how many
    words they share at least, and the largest one tells it exactly; the two
    least ids that have it for each m are enough. 63 subsets of six words are
    listed, so the work is in proportion to the sets.
    """
    each = items.select("shelf", "id", "m", F.explode(subsets(F.col("words"))).alias("s"))
    index = least_two(each, ["shelf", "s", "m"]).groupBy("shelf", "s").agg(F.collect_list(F.struct("m", "id")).alias("has"))
    asks = items.filter("id = next").select("shelf", F.col("id").alias("_id"), F.col("m").alias("_m"), F.explode(subsets(F.col("words"))).alias("s"))
    shared = F.size("s")
    met = asks.join(index, ["shelf", "s"])
    near = F.filter("has", lambda x: x["id"] != F.col("_id"))
    scored = F.transform(near, lambda x: F.struct((-shared / (F.col("_m") + x["m"] - shared)).alias("s"), x["id"].alias("o")))
    top = met.select("shelf", "_id", F.array_min(scored).alias("top")).groupBy("shelf", "_id").agg(F.min("top").alias("top")).filter("top IS NOT NULL")
    return top.select("shelf", F.col("_id").alias("id"), F.col("top.o").alias("other"), (-F.col("top.s")).alias("score"))


def by_blocks(items: DataFrame) -> DataFrame:
    """(shelf, id, other, score) of the sets (shelf, words, id, next, m) whose ``next`` is their own id, among all of them.

    A word's rows stand in order of their number of words and are cut into
    blocks, the first of 16 rows. In round b only block b of a word is read,
    and by a row only if it may still hold something better than the row has:
    with r words left whose lists go on, another row of m words shares r at
    most. So long lists are read by few rows, a word that all rows of a shelf
    have is not joined at all but counted, and nothing is cut off: a row that needs a block gets it.
    """
    items = saved(items.select("shelf", "id", "words", "m", (F.col("id") == F.col("next")).alias("asks")))
    spread = items.select("shelf", "id", "m", F.explode("words").alias("w"))
    lists = placed(spread, ["shelf", "w"], [F.col("m"), F.col("id")])
    sizes = items.groupBy("shelf").agg(F.count("*").alias("rows"))
    lists = lists.join(sizes, "shelf").withColumn("everywhere", F.col("size") == F.col("rows"))
    lists = saved(lists.select("shelf", "w", "id", "m", "size", "everywhere", block_of(F.col("place")).alias("block")))

    # Words of all rows: counted for a shelf; the smallest other row has the best similarity by them alone.
    common = lists.filter("everywhere").groupBy("shelf").agg(F.count_distinct("w").alias("c"))
    smallest = W.partitionBy("shelf").orderBy("m", "id")
    two = items.join(common, "shelf").withColumn("nth", F.row_number().over(smallest)).filter("nth <= 2")
    two = two.groupBy("shelf").agg(F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("nth", "id", "m"))).alias("few"))
    state = items.join(two, "shelf", "left")
    pick = F.filter("few", lambda x: x["id"] != F.col("id"))
    state = state.withColumn("few", F.get(pick, F.lit(0)))
    state = state.select("shelf", "id", "m", "words", F.coalesce("c", F.lit(0)).alias("c"), F.col("few.id").alias("other"), F.coalesce(F.col("c") / (F.col("m") + F.col("few.m") - F.col("c")), F.lit(0.0)).alias("score"))
    state = saved(state.join(items.filter("asks").select("shelf", "id"), ["shelf", "id"], "left_semi"))

    rarer = saved(lists.filter("not everywhere"))
    blocks = saved(rarer.groupBy("shelf", "w", "size", "block").agg(F.min("m").alias("least_m"), F.min("id").alias("least_id")))
    last = blocks.agg(F.max("block")).first()[0]
    for b in range(0 if last is None else last + 1):
        # What is left of a row: its words whose lists go on at this block, and the common ones.
        going = rarer.select("shelf", "id", "w", "size").filter(F.col("size") > (0 if b == 0 else FIRST * 4 ** (b - 1)))
        left = going.groupBy("shelf", "id").agg(F.collect_list("w").alias("open"))
        asking = state.join(left, ["shelf", "id"]).withColumn("r", F.size("open") + F.col("c"))
        now = blocks.filter(F.col("block") == b).drop("block", "size")
        asked = asking.select("shelf", "id", "m", "r", "other", "score", F.explode("open").alias("w")).join(now, ["shelf", "w"])
        # Of rows with as many words as the block's least, or with r if that is more.
        bound = F.col("r") / (F.col("m") + F.greatest("least_m", "r") - F.col("r"))
        open_ = (bound > F.col("score")) | ((bound == F.col("score")) & (F.col("other").isNull() | (F.col("least_id") < F.col("other"))))
        here = rarer.filter(F.col("block") == b).select("shelf", "w", F.col("id").alias("_other"))
        met = asked.filter(open_).select("shelf", "w", "id").join(here, ["shelf", "w"]).filter("id <> _other").select("shelf", "id", "_other").distinct()
        sides = met.join(items.select("shelf", "id", "words"), ["shelf", "id"]).join(items.select("shelf", F.col("id").alias("_other"), F.col("words").alias("_words")), ["shelf", "_other"])
        both = F.size(F.array_intersect("words", "_words"))
        scored = sides.select("shelf", "id", "_other", (both / (F.size("words") + F.size("_words") - both)).alias("_score"))
        top = scored.groupBy("shelf", "id").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_other").alias("o"))).alias("top"))
        joined = state.join(top, ["shelf", "id"], "left")
        better = F.col("top").isNotNull() & ((-F.col("top.s") > F.col("score")) | ((-F.col("top.s") == F.col("score")) & (F.col("other").isNull() | (F.col("top.o") < F.col("other")))))
        state = saved(joined.select("shelf", "id", "m", "words", "c", F.when(better, F.col("top.o")).otherwise(F.col("other")).alias("other"), F.when(better, -F.col("top.s")).otherwise(F.col("score")).alias("score")))
    return state.select("shelf", "id", F.when(F.col("score") > 0, F.col("other")).alias("other"), "score")
