"""Byte-level BPE: long texts are pre-tokenised as overlapping chunks, stitched and then encoded; decoding joins raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenbank.llm.common import map_rows, saved

#: Code points of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 32_768, 1_024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load_encoding(path: str, pattern: str):
    """The library's merges over the rank file. Pieces are spans that begin and end at pre-token borders."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def token_bytes(path: str) -> list[bytes]:
    """The raw bytes of each id."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        out[i] = raw
    return out


class Digest:
    """Counts ids, and hashes their decimals joined by spaces and their decoded bytes, part by part."""

    def __init__(self, tables: tuple[list[bytes], list[str]]):
        self.raw, self.decimal = tables
        self.n, self.ids, self.bytes = 0, hashlib.sha256(), hashlib.sha256()

    @staticmethod
    def tables(path: str) -> tuple[list[bytes], list[str]]:
        raw = token_bytes(path)
        return raw, [str(i) for i in range(len(raw))]

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update(((" " if self.n else "") + " ".join(map(self.decimal.__getitem__, ids))).encode())
            self.bytes.update(b"".join(map(self.raw.__getitem__, ids)))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.bytes.hexdigest()


def borders(text: str, starts: list[int]) -> list[int]:
    """The pre-token starts where a text may be cut, so that both sides encode as they do within the whole.

    A start with white space before it is none: the pattern shares white space
    out by what follows it. Nor is the last code point, which may belong to a
    longer contraction. Holds for patterns without lookbehind whose only lookahead is after white space.
    """
    return [p for p in starts if 0 < p < len(text) - 1 and not text[p - 1].isspace()]


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """:func:`encode_sides` as one frame."""
    short, long = encode_sides(docs, path, pattern, chunk, overlap)
    return short.unionByName(long)


def encode_sides(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and longer ones. Token ids of ``text`` as rows (row, doc_id, part, ids); a row's ids are its parts' in order of ``part``.

    ``row`` tells repeated doc_ids apart. Texts of one chunk are encoded where
    they stand. A longer text becomes overlapping chunks that are pre-tokenised
    apart; a chunk hands over to the next at the first of the :func:`borders` that
    both have in their overlap, since from a common start on both go on alike.
    Then each chunk's span is encoded, so one long text is spread over tasks.
    Where an overlap has no common start (one pre-token spans it), the text's
    chunks are walked in order instead, with the open pre-token carried over.
    A null text is empty; an empty text has one part without ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    out = f"row long, doc_id {kind}, part int, ids array<int>"

    def whole():
        encoding = load_encoding(path, pattern)
        return lambda row, doc, text: [(row, doc, 0, encoding.encode_to_numpy(text, disallowed_special=()))]

    def cut():
        return lambda row, doc, text: ((row, doc, k, at + chunk >= len(text), text[at : at + chunk + overlap]) for k, at in enumerate(range(0, len(text), chunk)))

    def pretokenise():
        starts = regex.compile(pattern)

        def one(row, doc, part, last, text):
            at = borders(text, [m.start() for m in starts.finditer(text)])
            return [(row, doc, part, last, text, [p for p in at if p < overlap] if part else [0], [] if last else [p - chunk for p in at if p >= chunk])]

        return one

    def span():
        encoding = load_encoding(path, pattern)
        return lambda row, doc, part, text, begin, end: [(row, doc, part, encoding.encode_to_numpy(text[begin : len(text) if end is None else chunk + end], disallowed_special=()))]

    short = map_rows(rows.filter(size <= chunk), whole, out)
    chunks = map_rows(rows.filter(size > chunk), cut, f"row long, doc_id {kind}, part int, last boolean, text string")
    # Each chunk is its own unit of work from here on.
    chunks = chunks.repartition(F.col("row"), F.col("part"))
    found = map_rows(chunks, pretokenise, f"row long, doc_id {kind}, part int, last boolean, text string, head array<int>, tail array<int>")
    by_row = W.partitionBy("row").orderBy("part")
    met = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_row))))
    found = found.select("row", "doc_id", "part", "last", "text", met.alias("begin"))
    # Written once: two branches read it, and the rows' numbers must be the same in both.
    found = saved(found.withColumns({"end": F.lead("begin").over(by_row), "apart": F.max(F.col("begin").isNull()).over(W.partitionBy("row"))}))
    spans = map_rows(found.filter(~F.col("apart")).select("row", "doc_id", "part", "text", "begin", "end"), span, out)
    walked = found.filter("apart").select("row", "doc_id", "part", "last", "text").repartition("row").sortWithinPartitions("row", "part")
    return short, spans.unionByName(walked.mapInArrow(_walk(path, pattern, chunk), out))


def _walk(path: str, pattern: str, chunk: int):
    """Encodes the chunks of a text in order, with the open pre-token carried over.

    While one pre-token goes on over many chunks, it is matched anew only when
    it has doubled, so that the work stays in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        encoding, matcher, carry, now, enough = load_encoding(path, pattern), regex.compile(pattern), [], None, 0
        for batch in batches:
            kinds = pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field(1).type), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))])
            for at in range(batch.num_rows):
                row, doc, part, last, text = (c[at].as_py() for c in batch.columns)
                if row != now:
                    carry, now, enough = [], row, 0
                carry.append(text if last else text[:chunk])
                ids: list[int] = []
                if last or sum(map(len, carry)) >= enough:
                    open_text = "".join(carry)
                    # What follows the last border may still be shared out otherwise; all before it is settled.
                    stop = len(open_text) if last else max(borders(open_text, [m.start() for m in matcher.finditer(open_text)]), default=0)
                    ids, carry = encoding.encode_ordinary(open_text[:stop]), [open_text[stop:]]
                    enough = 2 * len(carry[0])
                yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc], "part": [part], "ids": [ids]}, schema=kinds)

    return run


def decode(parts: DataFrame, path: str) -> DataFrame:
    """The bytes of ``ids`` as ``raw``: the tokens' raw bytes one after the other, since a part may end inside a character."""

    def make():
        raw = token_bytes(path)
        return lambda *v: [(*v[:-1], b"".join(map(raw.__getitem__, v[-1])))]

    keep = [c for c in parts.columns if c != "ids"]
    return map_rows(parts.select(*keep, "ids"), make, ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in keep) + ", raw binary")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(parts: DataFrame, path: str) -> DataFrame:
    """doc_id and the :class:`Digest` of each ``row`` of parts that stand together and in order; a task never holds more than one part."""
    schema = StructType.fromDDL(f"doc_id {parts.schema['doc_id'].dataType.simpleString()}, {DIGEST}")

    def run(batches):
        tables, arrow = Digest.tables(path), to_arrow_schema(schema)
        now = doc = held = None
        for batch in batches:
            done = []
            for at, (row, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if row != now:
                    if now is not None:
                        done.append((doc, *held.row()))
                    now, doc, held = row, doc_id, Digest(tables)
                held.add(batch.column(2)[at].values.to_numpy().tolist())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), arrow)], schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((doc, *held.row()), arrow)], schema=arrow)

    return parts.select("row", "doc_id", "ids").mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encodes and decodes ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row of ``docs``.

    Texts of one chunk go through encoder and digest in one worker, so their
    ids never leave it; the parts of longer ones meet in order.
    """

    def make():
        encoding, tables = load_encoding(path, pattern), Digest.tables(path)

        def one(doc, text):
            held = Digest(tables)
            held.add(encoding.encode_to_numpy(text, disallowed_special=()).tolist())
            return [(doc, *held.row())]

        return one

    text = F.coalesce("text", F.lit(""))
    short = docs.select("doc_id", text.alias("text")).filter(F.length("text") <= chunk)
    long = encode_sides(docs, path, pattern, chunk, overlap)[1]
    return map_rows(short, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}").unionByName(digest(long.repartition("row").sortWithinPartitions("row", "part"), path))
