"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents, then exact containment.

DataFrame functions only. An item that shares a part ``share`` of its n
shingles misses at most (1 - share) n of them, so among any
m = n - ceil(share n) + 1 of its shingles the document has one. The m with
the smallest hashes are the item's MinHash sketch. Items are partitioned by
size: a document is tried against a partition only if it has as many shingles
as the smallest item there needs, with those of its shingles whose hash is at
most the largest in the partition's own sketches, and the join is on
(partition, hash). So the search finds every document that the exact check
would accept, and tries large items with few of a document's shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbank.llm.common import key_of, saved, small_side

#: Words of a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, SHARE = 5, 0.8
#: Sizes of items (in shingles) below which each partition ends; the last is open.
PARTITIONS = (8, 16, 32, 64, 128, 512)
#: Rows of a join side that may be broadcast.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Each n words joined by spaces; nothing if there are fewer."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))


def shingle_hashes(hashed: Column, n: int = SHINGLE) -> Column:
    """A hash of each n words from the words' hashes; nothing if there are fewer."""
    return F.transform(F.slice(hashed, 1, F.greatest(F.size(hashed) - n + 1, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, n)]))


def by_length(w: Column, make) -> Column:
    """An item's shingles: of SHINGLE words, or of all its words if it has fewer."""
    return reduce(lambda rest, n: F.when(F.size(w) == n, make(w, n)).otherwise(rest), range(1, SHINGLE), make(w, SHINGLE))


def hashed_words(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def item_sketches(items: DataFrame, share: float = SHARE) -> DataFrame:
    """item (the key of its id and text), length (words of a shingle), part (of its size), least (shingles that a document must share), hash: the MinHash sketch of each item that has words."""
    # Arrays that a lambda reads are columns of their own, or each element would compute them again.
    rows = items.select(key_of(items, ["item_id", "text"]).alias("item"), hashed_words(words(F.col("text"))).alias("hashed"))
    rows = rows.select("item", F.least(F.size("hashed"), F.lit(SHINGLE)).alias("length"), F.array_sort(F.array_distinct(by_length(F.col("hashed"), shingle_hashes))).alias("hashes"))
    size = F.size("hashes")
    part = sum((F.when(size >= p, 1).otherwise(0) for p in PARTITIONS), F.lit(0))
    least = F.ceil(F.lit(share) * size).cast("int")
    return rows.filter(size > 0).distinct().select("item", "length", part.alias("part"), least.alias("least"), F.explode(F.slice("hashes", 1, size - least + 1)).alias("hash"))


def tried(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """row, length, part and hash: the shingles of each document (row, text) that are tried against each partition."""
    # A row for each partition of each shingle length, from the sizes that PARTITIONS bounds.
    parts = sketches.groupBy("length", "part").agg(F.max("hash").alias("limit"), F.min("least").alias("least")).orderBy("length", "part").collect()
    rows = docs.select("row", hashed_words(words(F.col("text"))).alias("hashed"))
    lengths = sorted({r.length for r in parts})
    rows = rows.select("row", *[F.array_distinct(shingle_hashes(F.col("hashed"), n)).alias(f"of_{n}") for n in lengths])

    def against(r) -> Column:
        fit = F.filter(f"of_{r.length}", lambda h: h <= r.limit)
        one = F.transform(fit, lambda h: F.struct(F.lit(r.length).alias("length"), F.lit(r.part).alias("part"), h.alias("hash")))
        return F.when(F.size(f"of_{r.length}") >= r.least, one).otherwise(F.array().cast("array<struct<length:int,part:int,hash:bigint>>"))

    return rows.select("row", F.explode(F.flatten(F.array(*map(against, parts)))).alias("t")).select("row", "t.*")


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct (row, item) where the document has a shingle of the item's sketch."""
    keys = small_side(sketches.select("length", "part", "hash", "item"), BROADCAST_ROWS)
    return tried(docs, sketches).join(keys, ["length", "part", "hash"]).select("row", "item").distinct()


def holding(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame | None:
    """``row`` (of ``docs``: row, text), item_id, n_item and n_shared of every document that holds an item; None if no item has words."""
    sketches = saved(item_sketches(items, share))
    if sketches.isEmpty():
        return None
    lengths = sorted(r.length for r in sketches.select("length").distinct().collect())  # SHINGLE of them at most
    pairs = saved(candidates(docs, sketches))
    # Texts of documents with a candidate, and their shingles, once each.
    some = small_side(pairs.select("row").distinct(), BROADCAST_ROWS)
    held = docs.join(some, "row", "left_semi").select("row", words(F.col("text")).alias("w")).dropDuplicates(["row"])
    held = held.select("row", F.array_distinct(F.flatten(F.array(*[shingles(F.col("w"), n) for n in lengths]))).alias("has"))
    whole = items.select(key_of(items, ["item_id", "text"]).alias("item"), "item_id", words(F.col("text")).alias("w")).select("item", "item_id", F.array_distinct(by_length(F.col("w"), shingles)).alias("wants"))
    joined = held.join(small_side(pairs, BROADCAST_ROWS), "row").join(whole, "item")
    shared = F.size(F.array_intersect("has", "wants")).cast("long")
    out = joined.select("row", "item_id", F.size("wants").cast("long").alias("n_item"), shared.alias("n_shared"))
    return out.filter((F.col("n_shared") > 0) & (F.col("n_shared") >= F.ceil(F.lit(share) * F.col("n_item"))))


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment where a document holds ``share`` or more of an item's different shingles.

    Texts are compared as lower-cased runs of letters and digits, in shingles
    of five words; an item with fewer words is one shingle of that length, and
    is looked for in documents of any length. Null and empty texts match
    nothing. Equal texts are searched once; repeated rows give repeated
    results, and null ids stay null; other columns are ignored; with no
    documents or no items there are no rows. Candidates are checked on the
    shingles themselves, so hashes never decide.
    """
    texts = docs.select("doc_id", key_of(docs, ["text"]).alias("row"), "text")
    found = holding(texts.select("row", "text"), items, share)
    if found is None:
        nothing = {"item_id": items.schema["item_id"].dataType, "n_item": "long", "n_shared": "long", "containment": "double"}
        return docs.limit(0).select("doc_id", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    rows = texts.select("doc_id", "row").join(small_side(saved(found), BROADCAST_ROWS), "row")
    return rows.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without those whose text holds an item, with all their columns.

    Texts decide, not ids: every row with such a text goes, also with a null
    or repeated doc_id, and no other row does. Without items all rows stay.
    """
    keyed = docs.withColumn("_key", key_of(docs, ["text"]))
    found = holding(keyed.select(F.col("_key").alias("row"), "text"), items, share)
    if found is None:
        return docs
    gone = saved(found.select(F.col("row").alias("_key")).distinct())
    return keyed.join(small_side(gone, 2_000_000), "_key", "left_anti").select(docs.columns)
