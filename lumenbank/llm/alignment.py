"""Alignment of two tokenizers: groups of tokens between common byte offsets, and the documents that hold each pair of linked ids."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbank.llm.common import SLICE, map_rows, saved

#: A pair of ids is one int64: the first shifted by so many bits, and the second. Vocabularies may have a million ids.
SHIFT = 20

#: Occurrence pairs that are expanded at a time; a group of more is counted by its distinct ids.
LINKS, GROUP = 4_000_000, 65_536

#: Keys that a task sorts at once, and distinct ones that it holds before it hands them on.
SORTED, HELD = 2_000_000, 4_000_000


class Tokens:
    """A tokenizer: ``encode`` gives ids, ``raw`` each id's bytes; ``lossless`` if they only ever split the text's bytes."""

    def __init__(self, encode: Callable[[str], np.ndarray], raw: list[bytes], lossless: bool):
        self.encode, self.raw, self.lossless = encode, raw, lossless
        self.size = np.array([len(x) for x in raw], dtype=np.int64)

    def ids(self, text: str, whole: bytes) -> np.ndarray | None:
        """The ids of ``text``, or None if their bytes aren't ``whole``."""
        ids = np.asarray(self.encode(text), dtype=np.int64)
        same = self.size[ids].sum() == len(whole) if self.lossless else b"".join(map(self.raw.__getitem__, ids.tolist())) == whole
        return ids if same else None


def byte_level(path: str) -> Tokens:
    """A byte-level BPE from its JSON file, special tokens left out.

    Its ids stand in the order of its merges (checked), so the vocabulary
    serves as merge ranks; tests hold the ids against the file's own library.
    """
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocabulary, special = held["model"]["vocab"], {x["content"] for x in held["added_tokens"]}
    # Printable bytes stand for themselves, the others for the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError(f"the ids of {path} are not in the order of its merges")
    raw = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        raw[i] = piece
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokens(lambda text: encoding.encode_to_numpy(text, disallowed_special=()), raw, True)


def pieces(path: str) -> Tokens:
    """A piece model: U+2581 is a space, byte pieces are their byte, control pieces have no bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def raw(i: int) -> bytes:
        if model.is_control(i) or model.is_unknown(i):
            return b""
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Tokens(lambda text: model.encode(text, num_threads=1), [raw(i) for i in range(model.get_piece_size())], False)


class Groups:
    """Two token sequences of the same bytes, cut at the offsets where tokens of both end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        # Both end with the text, so each end has a place among the other ones.
        at = np.searchsorted(ends_b, ends_a)
        self.cut_a, self.cut_b = ends_b[at] == ends_a, np.zeros(len(b), bool)
        self.cut_b[at[self.cut_a]] = True
        self.of_a, self.of_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        # Where the tokens of a group end.
        self.end_a, self.end_b = np.flatnonzero(self.cut_a) + 1, np.flatnonzero(self.cut_b) + 1
        self.n = len(self.end_a)
        self.n_a, self.n_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)
        self.links = self.n_a * self.n_b

    def written(self, decimal: list[str], width: int) -> str:
        """``a1,a2|b1;a3|b2,b3``; ``decimal`` has ``width`` numbers with each of ``,`` ``|`` ``;`` after them."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + (self.end_b - self.n_b)[self.of_a]] = self.a + width * self.cut_a
        out[np.arange(len(self.b)) + self.end_a[self.of_b]] = self.b + 2 * width * self.cut_b
        return "".join(map(decimal.__getitem__, out.tolist()))[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct pairs of linked ids, and how many links have each."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        large = self.links > GROUP
        if large.any():
            for g in np.flatnonzero(large):
                (a, times_a), (b, times_b) = (np.unique(ids[of == g], return_counts=True) for ids, of in ((self.a, self.of_a), (self.b, self.of_b)))
                step = max(1, LINKS // len(b))
                for k in range(0, len(a), step):
                    held.append((((a[k : k + step, None] << SHIFT) | b).ravel(), np.multiply.outer(times_a[k : k + step], times_b).ravel()))
        first_b, part = self.end_b - self.n_b, np.cumsum(self.links) // LINKS
        for p in np.unique(part):
            mine = (part[self.of_a] == p) & ~large[self.of_a]
            of = self.of_a[mine]
            times = self.n_b[of]
            ends = np.cumsum(times)
            beside = np.repeat(first_b[of] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)
            held.append(np.unique((np.repeat(self.a[mine], times) << SHIFT) | self.b[beside], return_counts=True))
        return held[0] if len(held) == 1 else summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts)


def pack(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys as differences, and their times, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T for x in (np.diff(keys, prepend=0), times)]
    return zstandard.compress(np.vstack(planes).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(16, -1)
    gaps, times = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(gaps), times


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both encodings of every text, cut into groups: doc_id, counts, the groups' digest and the packed ``pairs`` (null without tokens).

    A gets a space before the text, which B adds itself. A text that is null or
    empty, or that one of the two does not give back byte for byte, has no tokens: zeros and an empty digest.
    """

    def make():
        a, b = byte_level(path_a), pieces(path_b)
        width = max(len(a.raw), len(b.raw))
        decimal = [f"{i}{mark}" for mark in (",", "|", ";") for i in range(width)]

        def one(doc, text):
            whole = b" " + text.encode() if text else None
            ids_a = a.ids(" " + text, whole) if text else None
            ids_b = b.ids(text, whole) if ids_a is not None else None
            if ids_b is None:
                return [(doc, 0, 0, 0, 0, "", None)]
            groups = Groups(ids_a, ids_b, a.size, b.size)
            written = hashlib.sha256(groups.written(decimal, width).encode()).hexdigest()
            return [(doc, len(ids_a), len(ids_b), groups.n, int(groups.links.sum()), written, pack(*groups.pairs()))]

        return one

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ALIGNED}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): partial counts of documents, many rows a key at most one for each task and flush."""

    def run(batches: Iterator[pa.RecordBatch]):
        keys, counts, waiting, n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            fresh, found = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.int64), np.empty(0, np.int64))
            return summed(np.concatenate([keys, fresh]), np.concatenate([counts, found]))

        def rows():
            for k in range(0, len(keys), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 65_536]), pa.array(counts[k : k + 65_536])], names=["key", "n"])

        for batch in batches:
            for packed in batch.column(0):
                waiting.append(unpack(packed.as_py())[0])
                n += len(waiting[-1])
                if n >= SORTED:
                    keys, counts = merged()
                    waiting, n = [], 0
                    if len(keys) >= HELD:
                        yield from rows()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield from rows()

    return aligned.filter("pairs is not null").select("pairs").mapInArrow(run, "key long, n long")


def total_counts(partial: DataFrame) -> DataFrame:
    """(key, n) in sorted ranges of keys: partial counts of a key stand together and each run is summed as it passes."""
    ranged = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ranged.mapInArrow(run_sums, "key long, n long")


def run_sums(batches: Iterator[pa.RecordBatch]):
    """Sums of runs of equal keys over sorted batches; the last key of a batch waits for the next one."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            keys, counts = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((keys, counts)))
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
            if len(keys) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(counts[:-1])], names=["key", "n"])
            keys, counts = keys[-1:], counts[-1:]
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


SHARD = "name string, first long, n long, a long, best long"


def shards(totals: DataFrame, folder: str) -> DataFrame:
    """Writes each range of (key, n) as two flat files in ``folder``, which all executors share, and tells what they hold.

    A row with a name is a shard; the others have the highest count of an A id
    in one shard. File names are new for each attempt, so a repeated task
    harms nothing: the rows of the attempt that counts name its files.
    """

    def run(batches):
        name, first, size, best = uuid.uuid4().hex, None, 0, {}
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}.keys", "wb") as keys, open(f"{folder}/{name}.counts", "wb") as counts:
            for batch in batches:
                if not batch.num_rows:
                    continue
                k, n = (np.ascontiguousarray(c.to_numpy(), dtype="<i8") for c in batch.columns)
                first = int(k[0]) if first is None else first
                size += len(k)
                keys.write(k.tobytes())
                counts.write(n.tobytes())
                a = k >> SHIFT
                starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                for i, most in zip(a[starts].tolist(), np.maximum.reduceat(n, starts).tolist()):
                    best[i] = max(most, best.get(i, 0))
        rows = [(name, first, size, None, None)] * bool(size) + [(None, None, None, i, most) for i, most in best.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], names=["name", "first", "n", "a", "best"])

    return totals.mapInArrow(run, SHARD)


class Counts:
    """The sorted shards, memory-mapped; workers of a machine share their pages."""

    def __init__(self, folder: str, found: list[tuple[str, int, int]]):
        self.found, self.open = sorted(found, key=lambda x: x[1]), {}
        self.folder, self.firsts = folder, np.array([x[1] for x in self.found], dtype=np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which are there."""
        out, shard = np.empty(len(keys), np.int64), np.searchsorted(self.firsts, keys, "right") - 1
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else []
        for begin, end in zip(cuts, [*cuts[1:], len(keys)]):
            s = int(shard[begin])
            if s not in self.open:
                self.open[s] = [np.memmap(f"{self.folder}/{self.found[s][0]}.{kind}", dtype="<i8", mode="r") for kind in ("keys", "counts")]
            held, counts = self.open[s]
            at = np.searchsorted(held, keys[begin:end])
            if not np.array_equal(held[np.minimum(at, len(held) - 1)], keys[begin:end]):
                raise ValueError("a pair is in no shard")
            out[begin:end] = counts[at]
        return out


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def shared_folder(df: DataFrame) -> str | None:
    """The session's checkpoint folder as a path that tasks can open, or None if it is in a store that only Spark reads."""
    at = urlparse(df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get())
    return unquote(at.path) if at.scheme in ("", "file") else None


def scored(docs: DataFrame, path_a: str, path_b: str, mapped: bool = True) -> DataFrame:
    """The aligned texts with what the corpus says of their links: ``n_best`` and ``count_sum``; a row for each row of ``docs``.

    A pair's count is the number of rows that hold it linked; a link is best if
    no pair of its A id has a higher count. The sorted count shards are written
    to the shared folder and memory-mapped by the tasks. Where that folder is
    no mounted path, or ``mapped`` is False, the pairs are joined to the counts instead.
    """
    aligned = saved(align(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    totals, folder = total_counts(saved(pair_counts(aligned))), shared_folder(aligned)
    if not mapped or folder is None:
        return joined(aligned, saved(totals))
    folder = f"{folder}/pairs-{uuid.uuid4().hex}"
    made = saved(shards(totals, folder))
    # One row a shard, and at most one for each id of A's vocabulary.
    found = [(r.name, r.first, r.n) for r in made.filter("name is not null").collect()]
    highest = made.filter("a is not null").groupBy("a").agg(F.max("best").alias("best")).collect()
    best = np.zeros(1 + max((r.a for r in highest), default=0), np.int64)
    best[[r.a for r in highest]] = [r.best for r in highest]

    def run(batches):
        counts = Counts(folder, found)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held = [unpack(p) if p is not None else (np.empty(0, np.int64),) * 2 for p in part.column(part.num_columns - 1).to_pylist()]
                keys, times = (np.concatenate([x[k] for x in held]) for k in (0, 1))
                ends = np.cumsum([len(k) for k, _ in held])
                each, place = np.unique(keys, return_inverse=True)
                n = counts.of(each)
                top = n == best[each >> SHIFT]
                sums = [np.append(0, np.cumsum(x))[ends] for x in (times * top[place], times * n[place])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(np.diff(x, prepend=0)) for x in sums]], names=[*part.schema.names[:-1], "n_best", "count_sum"])

    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in keep)
    return aligned.select(*keep, "pairs").mapInArrow(run, f"{kinds}, n_best long, count_sum long").select(*RESULT)


def joined(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """What :func:`scored` returns, by a join of all pairs with their counts; a pair of many documents is a key that Spark splits."""

    def spread(batches):
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, times = unpack(packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys), pa.array(times)], names=["row", "key", "times"])

    a = F.shiftright("key", SHIFT)
    # One row for each A id: its vocabulary is the bound.
    best = F.broadcast(totals.groupBy(a.alias("a")).agg(F.max("n").alias("best")))
    pairs = aligned.filter("pairs is not null").select("row", "pairs").mapInArrow(spread, "row long, key long, times long")
    found = pairs.join(totals, "key").join(best, a == F.col("a"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return aligned.join(sums, "row", "left").select(*[c for c in aligned.columns if c not in ("row", "pairs")], *zero).select(*RESULT)
