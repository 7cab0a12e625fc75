"""Fingerprints of documents: a Merkle tree of pieces, paragraphs and sections, and the likeness of two trees."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenbank.llm.common import SLICE, map_rows, saved

#: A paragraph: a line with its line feed.
LINE = re.compile(r"[^\n]*\n|[^\n]+")

#: A piece of a paragraph: up to sixteen words of at most 64 characters, ended early by a sentence's mark, with the white space at the paragraph's end; or else a run of white space.
PIECE = re.compile(r"(?:\s{0,64}\S{0,63}[^\s.!?]){0,15}\s{0,64}\S{1,64}(?:\s{1,64}\Z)?|\s{1,1024}")

#: A line that begins a section of its own: a heading by its marks.
HEADING = re.compile(r"\s{0,3}#{1,6}\s")

#: A paragraph ends its section if the first byte of its digest is under this, so one in eight does, whatever stands before.
SECTION = 32

#: Bytes of the root, and of a piece: four of its digest, two of its level and length.
ROOT, RECORD = 32, 6

#: Levels of a piece: it goes on with its paragraph, or begins a paragraph, or a section.
GOES_ON, PARAGRAPH, SECTION_START = 0, 1, 2

LENGTH_BITS = 14


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).digest()


def fingerprint(text: str) -> bytes:
    """The root of a text's tree, then a record for each piece in order.

    A paragraph is a line with its line feed; its node is over its pieces'
    digests. A section is a run of paragraphs, cut before headings and after
    paragraphs by their digest, so that an edit moves no border elsewhere. The
    root is over the sections, and two texts have one root only if they are
    equal. An empty text has a root without sections.
    """
    sections, paragraphs, records, opens = [], [], [], True
    for line in LINE.findall(text):
        if paragraphs and HEADING.match(line):
            sections.append(node(paragraphs))
            paragraphs, opens = [], True
        level, leaves = SECTION_START if opens else PARAGRAPH, []
        for piece in PIECE.findall(line):
            leaf = hashlib.sha256(piece.encode()).digest()
            leaves.append(leaf)
            records.append(leaf[:4] + (level << LENGTH_BITS | len(piece)).to_bytes(2, "big"))
            level = GOES_ON
        paragraphs.append(node(leaves))
        opens = paragraphs[-1][0] < SECTION
        if opens:
            sections.append(node(paragraphs))
            paragraphs = []
    if paragraphs:
        sections.append(node(paragraphs))
    return node(sections) + b"".join(records)


class Branches:
    """A fingerprint read again: sections of paragraphs of pieces, each piece a record without its level, with its place in the text."""

    def __init__(self, made: bytes):
        self.root, self.n_chars, self.sections = made[:ROOT], 0, []
        for k in range(ROOT, len(made), RECORD):
            word = int.from_bytes(made[k + 4 : k + RECORD], "big")
            level, length = word >> LENGTH_BITS, word & (1 << LENGTH_BITS) - 1
            if level == SECTION_START:
                self.sections.append([])
            if level != GOES_ON:
                self.sections[-1].append([])
            self.sections[-1][-1].append((made[k : k + 4], length, self.n_chars))
            self.n_chars += length


def apart(branches: list, others: list, key) -> tuple[list, list]:
    """What is left of two lists of branches when equal ones have been paired off."""
    spare = Counter(map(key, others))
    left = []
    for b in branches:
        k = key(b)
        if spare[k]:
            spare[k] -= 1
        else:
            left.append(b)
    rest = []
    for b in reversed(others):  # the last of equal ones are over
        k = key(b)
        if spare[k]:
            spare[k] -= 1
            rest.append(b)
    return left, rest[::-1]


def compare(one: bytes, other: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Likeness from 0 to 1, and the spans (begin, end) of the first text that the other one lacks.

    Equal roots are equal texts. Else equal sections are paired off, then equal
    paragraphs of the sections left, then equal pieces of the paragraphs left;
    what remains is different. The likeness is twice the characters in common over
    those of both texts; the order of what they have in common isn't weighed.
    """
    if one[:ROOT] == other[:ROOT]:
        return 1.0, []
    a, b = Branches(one), Branches(other)
    piece = lambda p: p[:2]
    paragraph = lambda ps: tuple(map(piece, ps))
    left, rest = apart(a.sections, b.sections, lambda s: tuple(map(paragraph, s)))
    left, rest = apart([p for s in left for p in s], [p for s in rest for p in s], paragraph)
    left, rest = apart([x for p in left for x in p], [x for p in rest for x in p], piece)
    total = a.n_chars + b.n_chars
    differ = sum(x[1] for x in left) + sum(x[1] for x in rest)
    spans: list[tuple[int, int]] = []
    for _, length, at in left:
        if spans and spans[-1][1] == at:
            spans[-1] = (spans[-1][0], at + length)
        else:
            spans.append((at, at + length))
    return (total - differ) / total, spans


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows that a task gives: results, and the first and the last row of its partition.
DONE, FIRST, LAST = 0, 1, 2

RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, first_edit long"
STEP = "kind int, part int, text string"


def judged(text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    """The :data:`RESULT` of a text with its fingerprint, beside the text that follows it; ``first_edit`` is where the edited text parts from it."""
    changed = edited(text, following)
    made = fingerprint(changed)
    near, spans = compare(own, made)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, made, near, compare(own, next_own)[0], spans[0][0] if spans else None


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every text with its fingerprint, its edited text's, and their likeness to it and to the next text's: doc_id and the columns of the query.

    Rows are dealt by ranges of (doc_id, hash of the text), null ids first, and
    pass sorted through each task, which holds one row until the next one comes.
    The last row of a partition meets the first of the next partition with rows
    (after the last: the first) in a join of two rows a partition. A null text
    is empty; repeated rows follow one another; the next of a single row is itself. No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange("doc_id", "hash", "tie").sortWithinPartitions("doc_id", "hash").select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = StructType.fromDDL(f"doc_id {kind}, {STEP}, {RESULT}")
    nothing = (None,) * 7

    def run(batches):
        arrow, held = to_arrow_schema(schema), None

        def rows_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = []
                for doc, text, part in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    own = fingerprint(text)
                    if held is None:
                        found.append((doc, FIRST, part, text, *nothing))
                    else:
                        found.append((held[0], DONE, held[1], None, *judged(held[2], held[3], text, own)))
                    held = doc, part, text, own
                yield rows_of(found)
        if held is not None:
            yield rows_of([(held[0], LAST, held[1], held[2], *nothing)])

    passed = saved(ranged.mapInArrow(run, schema))
    parts = passed.filter(F.col("kind") == FIRST).select("part")
    by_part = W.orderBy("part")  # a row for each partition
    order = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("after"))
    firsts = passed.filter(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("following"))
    ends = passed.filter(F.col("kind") == LAST).select("doc_id", "part", "text").join(order, "part").join(firsts, "after")

    def last():
        return lambda doc, text, following: [(doc, *judged(text, fingerprint(text), following, fingerprint(following)))]

    done = passed.filter(F.col("kind") == DONE).drop("kind", "part", "text").unionByName(map_rows(ends.select("doc_id", "text", "following"), last, f"doc_id {kind}, {RESULT}"))
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
