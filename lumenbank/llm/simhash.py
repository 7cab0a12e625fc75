"""SimHash near-duplicates: shards of fingerprints that may be close, a BK-tree for each, and components of the links."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbank.llm.common import map_rows, saved, shingle_hashes, small_side
from lumenbank.llm.graph import components

__all__ = ["EXACT", "Settings", "fingerprint", "fingerprint_hex", "fingerprint_of", "fingerprints", "keep_one", "links", "near_duplicates"]

#: Fingerprints of a shard tree; a larger shard becomes blocks of about this many, each a tree for every later block.
TREE = 4_096
#: Rows of a worker's forest, and pairs of its search front at a time (over the words of a fingerprint). A front takes
#: some 200 bytes a pair where a dense group lets it grow, in each worker.
FOREST_ROWS, FRONT = 40_000, 1 << 17


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, 64-bit words of a fingerprint and differing bits of a link."""

    shingle: int = 3
    words: int = 1
    radius: int = 3


EXACT = Settings()


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (k 0: itself)."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, settings: Settings) -> list[int]:
    """Signed 64-bit words; a bit is 1 if over half the hashes have it. No words: zero."""
    return fingerprint_of(shingle_hashes(text, settings.shingle), settings)


def fingerprint_of(h: np.ndarray, settings: Settings) -> list[int]:
    """The words of a fingerprint from the hashes themselves."""
    out = []
    for k in range(settings.words):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            part = mixed(h[at : at + 65_536], k)
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, settings: Settings = EXACT) -> DataFrame:
    """doc_id, ``signature`` and ``node``, the signature as one number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_rows(docs.select("doc_id", "text"), lambda: lambda i, t: [(i, fingerprint(t, settings))], f"doc_id {kind}, signature array<long>")
    node = F.col("signature")[0] if settings.words == 1 else F.xxhash64("signature")
    return found.withColumn("node", node)


def shard_masks(settings: Settings, rows: int) -> list[list[int]]:
    """For each table the bits that a pair must share, as signed words.

    By pigeonhole, m blocks of bits hold ``radius`` differences, so m - radius
    blocks are alike; m grows with the rows, so that a key has few of them.
    """
    bits = 64 * settings.words
    m = settings.radius + 1
    while rows >> (bits * (m - settings.radius) // m) > 64 and comb(m + 1, settings.radius) <= 56:
        m += 1
    borders = [bits * k // m for k in range(m + 1)]
    chosen = [[b for k in some for b in range(borders[k], borders[k + 1])] for some in combinations(range(m), m - settings.radius)]
    out = []
    for some in chosen:
        words = [sum(1 << (b % 64) for b in some if b // 64 == w) for w in range(settings.words)]
        out.append([w - (1 << 64) if w >> 63 else w for w in words])
    return out


def links(nodes: DataFrame, settings: Settings = EXACT, pairs: bool = False) -> DataFrame:
    """(a, b) edges between (node, signature) rows, enough of them to connect whatever links.

    A shard's links are joined up inside its task, and each node gets one edge
    to the first of its part of the shard, so a dense group gives no pairs.
    With ``pairs`` every edge is a link, by another choice of them.
    Shards above TREE are split into blocks; every block's tree goes to the
    task of each later block, so no task holds more than two blocks.
    """
    masks = shard_masks(settings, nodes.count())
    key = lambda t, m: F.xxhash64(F.lit(t), *[F.col("signature")[w].bitwiseAND(F.lit(x)) for w, x in enumerate(m) if x])
    keyed = nodes.select("node", "signature", F.explode(F.array(*[key(t, m) for t, m in enumerate(masks)])).alias("key"))
    hot = saved(keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > TREE))
    keyed = keyed.join(small_side(hot, 100_000), "key", "left")
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / TREE)
    keyed = keyed.select("key", "node", "signature", F.pmod(F.xxhash64("node", "key"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sharded = keyed.select(F.xxhash64("key", low, high).alias("shard"), "node", "signature", ((F.col("own") == low).cast("int") + 2 * (F.col("own") == high).cast("int")).alias("role"))  # 1: in the tree, 2: asks, 3: both
    sharded = sharded.repartition("shard").sortWithinPartitions("shard")
    return sharded.mapInArrow(_search(settings, pairs), "a long, b long")


def _search(settings: Settings, pairs: bool):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def close(final: bool):
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            shard = rows.column("shard").to_numpy()
            end = len(shard) if final else int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if end or final:
                part = rows.slice(0, end)
                held, size = rows.slice(end).to_batches(), len(shard) - end
                edges = forest_links(part, settings, pairs)
                if len(edges):
                    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
            return None

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOREST_ROWS and (out := close(False)) is not None:
                yield out
        if size and (out := close(True)) is not None:
            yield out

    return run


def forest_links(rows: pa.Table, settings: Settings, pairs: bool = False) -> np.ndarray:
    """Edges of whole shards, stars or linked pairs: a BK-tree for each, all searched together."""
    shard = rows.column("shard").to_numpy()
    node = rows.column("node").to_numpy()
    values = pa.chunked_array(rows.column("signature").chunks, rows.schema.field("signature").type).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rows), settings.words)
    in_tree, asks = (rows.column("role").to_numpy() & bit > 0 for bit in (1, 2))
    group = np.cumsum(np.concatenate([[0], shard[1:] != shard[:-1]])) if len(shard) else shard
    root, keys, children = build_forest(values, group, np.flatnonzero(in_tree))
    label = np.arange(len(rows))
    used: list[np.ndarray] | None = [] if pairs else None
    askers = np.flatnonzero(asks & (root[group] >= 0)) if len(rows) else np.zeros(0, np.int64)
    for a, b in search_forest(values, root[group[askers]] if len(askers) else askers, askers, keys, children, settings.radius):
        unite(label, a, b, used)
    if pairs:
        return node[np.concatenate([np.zeros((0, 2), np.int64), *used])]
    joined = np.flatnonzero(label != np.arange(len(rows)))
    return np.stack([node[joined], node[label[joined]]], axis=1)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def build_forest(values: np.ndarray, group: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots by group (-1: none), and edges sorted by (parent, distance) with their child.

    All trees grow a level at a time: of the rows that fall to one parent at
    one distance, the first becomes the child there and the others go below it.
    """
    groups = int(group[-1]) + 1 if len(group) else 0
    root = np.full(groups, -1)
    first, at = np.unique(group[members], return_index=True)
    root[first] = members[at]
    rest = members[root[group[members]] != members]
    parent = root[group[rest]]
    span = 64 * values.shape[1] + 1
    keys, children = [], []
    while len(rest):
        key = parent * span + distance(values[rest], values[parent])
        found, first, at = np.unique(key, return_index=True, return_inverse=True)
        child = rest[first]
        keys.append(found)
        children.append(child)
        below = child[at]
        stay = below != rest
        rest, parent = rest[stay], below[stay]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys, kind="stable")
    return root, keys[order], children[order]


def search_forest(values: np.ndarray, roots: np.ndarray, askers: np.ndarray, keys: np.ndarray, children: np.ndarray, radius: int):
    """Pairs of asker and tree node within ``radius``, following only edges within it of the distance to the parent."""
    span = 64 * values.shape[1] + 1
    most = FRONT // values.shape[1]
    fronts = [(askers, roots)]
    while fronts:
        a, n = fronts.pop()
        if len(a) > most:
            fronts += [(a[k : k + most // 2], n[k : k + most // 2]) for k in range(0, len(a), most // 2)]
            continue
        d = distance(values[a], values[n])
        hit = (d <= radius) & (a != n)
        if hit.any():
            yield a[hit], n[hit]
        low = np.searchsorted(keys, n * span + np.maximum(d - radius, 0))
        count = np.searchsorted(keys, n * span + np.minimum(d + radius, span - 1), side="right") - low
        if count.sum():
            which = np.repeat(np.arange(len(a)), count)
            edge = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            fronts.append((a[which], children[edge]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray, used: list[np.ndarray] | None = None) -> None:
    """Makes the labels of each pair one, in place; a label is the least row of its set. ``used`` takes the pairs that joined two sets."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        high, low = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(label, high, low)
        if used is not None:  # the first pair that gave a set its label
            gave = np.flatnonzero(label[high] == low)
            gave = gave[np.unique(high[gave], return_index=True)[1]]
            used.append(np.stack([a[gave], b[gave]], axis=1))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def near_duplicates(docs: DataFrame, settings: Settings = EXACT) -> DataFrame:
    """doc_id, signature and component_id (the least doc_id of those reachable over links, itself included) of every row.

    Equal fingerprints are one node, so copies cost a row each and no pair.
    A null or empty text has no words and fingerprint zero, and is linked like
    any other. Texts are linked, not ids: rows that share a doc_id may stand in
    different components, each named by the least doc_id there. Null ids keep a
    null component unless they reach another. Other columns are ignored; an
    empty table gives no rows. Fingerprints are saved once, since three steps
    read them; texts are read once and never shuffled.
    """
    found = saved(fingerprints(docs, settings))
    nodes = saved(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    roots = saved(components(links(nodes.select("node", "signature"), settings)))
    linked = nodes.join(roots, "node").select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    several = linked.join(least, "root").select("node", "component")
    copies = nodes.filter("copies > 1").join(roots, "node", "left_anti").select("node", F.col("least").alias("component"))
    return found.join(several.unionByName(copies), "node", "left").select("doc_id", "signature", F.coalesce("component", "doc_id").alias("component_id"))


def fingerprint_hex(signature: Column) -> Column:
    return F.lower(F.lpad(F.hex(signature[0]), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row for each group of near copies: fingerprints of five-word shingles meet first (see ``shingles``)."""
    from lumenbank.llm.shingles import keep_one  # which is built on this module

    return keep_one(docs)
