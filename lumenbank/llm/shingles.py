"""Near copies by the Jaccard similarity of five-word shingle sets: SimHash first, a prefix filter for what it misses, and every link checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lumenbank.llm import simhash
from lumenbank.llm.common import SEED, counted, gathered, key_of, map_rows, saved, shingle_hashes, small_side
from lumenbank.llm.graph import FEW, components
from lumenbank.llm.simhash import Settings, fingerprint_of

#: Words of a shingle. Sets are near copies if they share four fifths of their union: 9 |x & y| >= 4 (|x| + |y|).
SHINGLE = 5
#: Fingerprints of such sets that meet: at most six of 64 bits apart.
NEAR = Settings(shingle=SHINGLE, radius=6)
#: One document in so many is counted to tell common shingles, and most of those that are kept. They only order the
#: shingles; any order finds the same pairs, at more or less cost.
SAMPLE, MOST_COMMON = 16, 200_000

#: Hubs that sets apart are held against before all pairs of a group.
ROUNDS = 4

#: Pairs, and bytes of parities or sets, up to which they are sent whole to the tasks that need them; beyond, joins are shuffled.
FEW_PAIRS, FEW_BYTES = 50_000, 16 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE).view(np.int64))


def set_key(hashes: np.ndarray) -> int:
    """One signed number for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of the sample have, sorted, and how many."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    found = map_rows(some, lambda: lambda t: [(shingle_set(t),)], "hashes array<long>").select(F.explode("hashes").alias("shingle"))
    rows = found.groupBy("shingle").agg(F.count("*").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's rarest shingles, as many as a near copy can lack and one more: two near copies have one of them in common."""
    weight = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))][: len(hashes) - (4 * len(hashes) + 4) // 5 + 1]


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, at least two bits a hash: 1 if an odd number has it."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    return np.packbits(np.bincount(hashes & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


@F.pandas_udf(IntegerType())
def least_unlike(x: pd.Series, y: pd.Series) -> pd.Series:
    """Unlike bits of two parities, the longer one folded: their sets differ in as many elements at least."""

    def one(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, n), axis=0) for v in (a, b))
        return int(np.bitwise_count(a ^ b).sum())

    return pd.Series([one(a, b) for a, b in zip(x, y)], dtype="int32")


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key (``a``, ``b``), its text's hash ``t``, ``node`` (the key of its shingle set), the set's ``mark`` (its SimHash fingerprint), ``size``, ``prefix`` and ``parity``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def make():
        common, counts = shared.value

        def one(i, a, b, t, text):
            hashes = shingle_set(text)
            return [(i, a, b, t, set_key(hashes), fingerprint_of(hashes.view(np.uint64), NEAR)[0], len(hashes), prefix(hashes, common, counts), parities(hashes))]

        return one

    rows = docs.select("doc_id", key_of(docs).alias("key"), text_hash().alias("t"), "text").select("doc_id", "key.a", "key.b", "t", "text")
    return map_rows(rows, make, f"doc_id {kind}, a long, b long, t long, node long, mark long, size int, prefix array<long>, parity binary")


def text_hash() -> Column:
    return F.xxhash64("text")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def near_copies(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) pairs of nodes whose shingle sets, made again from the texts, are near copies.

    Sets are made only for pairs whose parities leave it open: near copies
    differ in a ninth of their sizes' sum at most. ``pairs`` is a saved frame.
    """
    if pairs.isEmpty():
        return pairs.select("a", "b")
    light = lambda df, size: F.broadcast(df) if size <= FEW_BYTES else df
    size = FEW_BYTES + 1
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        nodes, _, size = counted(nodes.join(F.broadcast(ends(pairs)), "node", "left_semi").select("node", "t", "size", "parity"), F.length("parity") + 24)
    side = lambda node, x: light(nodes.select(F.col("node").alias(node), F.col("size").alias(f"{x}_size"), F.col("parity").alias(x)), size)
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(9 * least_unlike("x", "y") <= F.col("x_size") + F.col("y_size"))
    pairs = gathered(pairs.select("a", "b"))
    held = gathered(nodes.join(small_side(ends(pairs), 2 * FEW_PAIRS), "node", "left_semi").select("t"), 8)
    texts = docs.select(text_hash().alias("t"), "text").join(small_side(held, 2_000_000), "t", "left_semi")

    def make():
        done = set()  # a task's copies of one text give one set

        def one(t, text):
            if t in done:
                return []
            done.add(t)
            return [(set_key(h := shingle_set(text)), h)]

        return one

    sets = map_rows(texts, make, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets, _, size = counted(sets, 8 * F.size("hashes") + 24)
    of = lambda node, x: light(sets.select(F.col("node").alias(node), F.col("hashes").alias(x)), size)
    both = small_side(pairs, FEW_PAIRS).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def alike_marks(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes whose fingerprints are at most ``NEAR.radius`` bits apart, enough of them to connect all such nodes.

    Nodes of one fingerprint meet the least of them, and these least ones meet
    by the shards and BK-trees of the SimHash operator.
    """
    prints = gathered(nodes.groupBy("mark").agg(F.min("node").alias("first"), F.count("*").alias("n")), 24)
    least = lambda mark, first: small_side(prints.select(F.col("mark").alias(mark), F.col("first").alias(first)), 2 * FEW)
    close = simhash.links(prints.select(F.col("mark").alias("node"), F.array("mark").alias("signature")), NEAR, pairs=True)
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(least("a", "x"), "a").join(least("b", "y"), "b").select("x", "y")
    several = small_side(prints.filter("n > 1").select("mark", "first"), 2_000_000)
    same = nodes.select("node", "mark").join(several, "mark").filter("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    return close.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (a, b) pairs whose ends have not one root."""
    roots = small_side(roots, 2 * FEW)
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("a_root IS NULL OR b_root IS NULL OR a_root <> b_root").select("a", "b")


def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The (a, b) pairs that are not in ``tried``, saved.

    They are joined on one number, and the ids decide: Spark holds a broadcast
    of any other key in memory pages of tens of MB, on each executor until the
    driver collects its garbage, and there is one each round.
    """
    both = F.xxhash64("a", "b")
    held = small_side(tried.select("a", "b"), FEW).select(both.alias("_pair"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    # Written so that the ids don't become keys of the join.
    same = (F.col("a").bitwiseXOR(F.col("_a")) == 0) & (F.col("b").bitwiseXOR(F.col("_b")) == 0)
    return gathered(pairs.withColumn("pair", both).join(held, (F.col("pair") == F.col("_pair")) & same, "left_anti").select("a", "b"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) edges between near copies, enough of them to connect whatever is linked.

    Sets with fingerprints close to each other meet first. A pair of 0.8 often has fingerprints
    further apart than any sharded search reaches, so a prefix filter,
    which misses none, finds the links that are left between the groups found by then.
    Sets that have a shingle of their prefixes in common are held
    against one of them, the hub: the one whose prefix has it earliest, as that
    rules out least. What is linked then has one root. In each of the next
    ``ROUNDS``, while that links anything, sets of other roots are held against another hub of
    the group's least root; and last those pairs meet that no chain of links
    joins. So a dense group is joined without all of its pairs. Each time,
    pairs whose sizes or places rule them out are passed over.
    """
    tried = gathered(alike_marks(nodes))
    found, n, _ = counted(near_copies(tried, docs, nodes))
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("place", "shingle"))
    group = W.partitionBy("shingle")
    shared = rows.withColumns({"hub": F.min(F.struct("place", "node", "size")).over(group), "n": F.count("*").over(group)})
    shared = gathered(shared.filter("n > 1").drop("n"), 48)
    # The first shingle that two sets share leaves no more in common than what follows it.
    may = lambda x: F.expr(f"5 * least(size, {x}size) >= 4 * greatest(size, {x}size) AND 9 * least(size - place, {x}size - {x}place) >= 4 * (size + {x}size)")
    pair = lambda x: [F.least("node", x).alias("a"), F.greatest("node", x).alias("b")]
    first = shared.filter("node <> hub.node").filter(may("hub.")).select(*pair("hub.node")).distinct()
    asked = untried(unjoined(first, components(found, rows=n)), tried)
    shared = shared.drop("hub")
    more, k, _ = counted(near_copies(asked, docs, nodes))
    tried, found, n = tried.unionByName(asked), found.unionByName(more), n + k
    for turn in range(ROUNDS + 1):
        roots = components(found, rows=n)
        apart = shared.join(small_side(roots, 2 * FEW), "node", "left").withColumn("root", F.coalesce("root", "node"))
        shared = apart = gathered(apart.withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group)}).filter("low < high").drop("high"), 40)
        shared = shared.drop("root", "low")  # what has one root now has one later too
        if turn == ROUNDS:
            break
        hub = F.min(F.when(F.col("root") == F.col("low"), F.struct("place", F.xxhash64("node", F.lit(turn)).alias("turn"), "node", "size"))).over(group)
        asked = untried(apart.withColumn("hub", hub).filter("root <> low").filter(may("hub.")).select(*pair("hub.node")).distinct(), tried)
        more, k, _ = counted(near_copies(asked, docs, nodes))
        tried, found, n = tried.unionByName(asked), found.unionByName(more), n + k
        if not k:
            break
    apart = apart.drop("low")
    other = apart.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "size", "place", "root")])
    met = apart.join(other, "shingle").filter("node < other_node AND root <> other_root").filter(may("other_"))
    rest = untried(met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct(), tried)
    return found.unionByName(near_copies(rest, docs, nodes))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns: the one with the least doc_id.

    Groups are of rows, so a doc_id may be null, which comes last, or stand on
    several rows: ties go to the least key of the whole row, and of rows alike
    in all columns one stays. Equal sets are one node; texts without words
    have the empty set. An empty table gives no rows.
    """
    weight = 8 * F.size("prefix") + F.length("parity") + 64
    found = gathered(prefixes(docs), weight)
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "a", "b"))
    nodes = gathered(found.groupBy("node").agg(first.alias("least"), F.count("*").alias("rows"), F.min("t").alias("t"), F.first("mark").alias("mark"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")), weight)
    edges, n, _ = counted(links(docs, nodes))
    roots = saved(components(edges, rows=n))
    group = nodes.join(small_side(roots, 2 * FEW), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "rows")
    least = gathered(group.groupBy("root").agg(F.min("least").alias("kept"), F.sum("rows").alias("rows")).filter("rows > 1"), 64)
    of_group = gathered(group.join(small_side(least.select("root", "kept"), FEW), "root").select("node", "kept"), 64)
    alike = gathered(found.select("node", "a", "b").join(small_side(of_group, FEW), "node").groupBy("a", "b", (F.col("a") == F.col("kept.a")).alias("same_a"), (F.col("b") == F.col("kept.b")).alias("same_b")).agg(F.count("*").alias("n")), 32)
    key = F.struct("a", "b").alias("_key")
    gone = gathered(alike.filter("NOT (same_a AND same_b)").select(key))
    again = gathered(alike.filter("same_a AND same_b AND n > 1").select(key))
    keyed = docs.withColumn("_key", key_of(docs))
    stay = keyed.join(small_side(gone, 2_000_000), "_key", "left_anti")
    if again.isEmpty():
        return stay.select(docs.columns)
    once = small_side(again, 2_000_000)
    return stay.join(once, "_key", "left_anti").unionByName(stay.join(once, "_key", "left_semi").dropDuplicates(["_key"])).select(docs.columns)
