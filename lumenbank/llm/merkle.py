"""A Merkle manifest of a table: leaves by source, 16 nodes a run, levels built bottom-up and proofs pushed top-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbank.llm.common import saved
from lumenbank.operators.ranks import placed

#: Nodes of a run, and characters of a digest.
RUN, HEX = 16, 64

#: What a leaf holds, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(*parts) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its UTF-8 bytes, ``:`` and its value, one after the other."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return h(*[one(c.cast("string")) for c in fields.values()])


def parent_of(place: Column) -> Column:
    return F.floor(place / RUN)


def build(nodes: DataFrame) -> list[DataFrame]:
    """The saved levels of all trees at once, leaves first, from (tree, place, size, digest); ``size`` is the tree's nodes on that level.

    Every node but a leaf has its ``children``, the digests of its run in
    order; leaves keep the other columns of ``nodes``. A tree ends on the level where it has one node, a lone leaf on the
    first. A run has at most 16 rows, so no group grows, whatever a tree's share of the rows.
    """
    levels = [saved(nodes.withColumn("children", F.expr("cast(null as array<string>)")))]
    most = levels[0].agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = levels[-1].filter("size > 1").groupBy("tree", F.ceil(F.col("size") / RUN).alias("size"), parent_of(F.col("place")).alias("place"))
        held = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("children"))
        levels.append(saved(held.select("tree", "place", "size", h(F.array_join("children", "")).alias("digest"), "children")))
        most = -(-most // RUN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    return reduce(DataFrame.unionByName, [x.filter("size = 1").select("tree", "digest") for x in levels])


def push(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The leaves with their proof and the other columns of their head, under heads (tree, proof, *rest*).

    From the top down, each child takes its parent's proof and puts before it
    the step of its own run: the digests beside it, left to right, and how
    many stand before its place. Levels above the leaves are saved.
    """
    rest = [c for c in heads.columns if c not in ("tree", "proof")]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level, head = levels[depth], heads.withColumnRenamed("tree", "_tree")
        own = [c for c in level.columns if c != "size"]
        rows = level.filter("size = 1").join(head, F.col("tree").eqNullSafe(F.col("_tree"))).select(*own, "proof", *rest)
        if above is not None:
            up = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_up"), F.col("children").alias("_run"), F.col("proof").alias("_proof"), *rest)
            at = (F.col("place") % RUN).cast("int")
            beside = F.concat(F.array_join(F.slice("_run", F.lit(1), at), ""), F.array_join(F.slice("_run", at + 2, F.lit(RUN)), ""))
            step = F.struct(at.alias("before"), beside.alias("digests"))
            joined = level.filter("size > 1").join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (parent_of(F.col("place")) == F.col("_up")))
            rows = rows.unionByName(joined.select(*own, F.concat(F.array(step), "_proof").alias("proof"), *rest))
        above = saved(rows) if depth else rows
    return above.drop("children")


NO_STEPS = "cast(array() as array<struct<before:int,digests:string>>)"


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and the steps of its proof give."""
    return F.aggregate(proof, digest, lambda acc, s: h(s["digests"].substr(F.lit(1), s["before"] * HEX), acc, s["digests"].substr(s["before"] * HEX + 1, F.length(s["digests"]))))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digests"]), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its place in the manifest: doc_id, source, leaf, subroot, root, proof, and ``tampered``, the leaf to test.

    Rows of one source stand by doc_id (null first), equal ones by leaf; a
    null source is a source. Where 5 divides the crc32 of the doc_id's decimal
    text, ``tampered`` is the leaf of the text with A-Z lower-cased, else the
    leaf itself, so also for a null doc_id. Repeated rows are leaves of their own;
    other columns are not part of a leaf; an empty table has no rows and no root.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf(fields | {"text": F.translate("text", UPPER, LOWER)})
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = saved(docs.select("doc_id", "source", leaf(fields).alias("leaf"), F.when(chosen, changed).alias("changed")))
    rows = placed(rows, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    levels = build(rows.select(F.col("source").alias("tree"), "place", "size", F.col("leaf").alias("digest"), "doc_id", "changed"))
    sources = placed(tops(levels).withColumnRenamed("tree", "source"), [], [F.col("source").asc_nulls_first()])
    over = saved(sources.withColumn("tree", F.lit("")))
    above = build(over.select("tree", "place", "size", "digest"))
    ends = push(above, tops(above).select("tree", F.col("digest").alias("root"), F.expr(NO_STEPS).alias("proof")))
    heads = saved(over.select("source", "place", F.col("digest").alias("subroot")).join(ends.drop("digest", "tree"), "place"))
    # The leaves meet their parents' proofs here, and a leaf's own proof is made in the task that uses it.
    found = push(levels, heads.select(F.col("source").alias("tree"), "subroot", "root", "proof"))
    return found.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "proof", F.coalesce("changed", "digest").alias("tampered"))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row: the tampered leaf is folded with the original proof."""
    found = manifest(docs).withColumn("folded_root", fold(F.col("tampered"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
