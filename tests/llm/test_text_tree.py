"""Document fingerprints against plain sequences of texts, and the tree's own properties."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumenbank.llm import text_tree
from lumenbank.llm.text_tree import PIECE, compare, edited, fingerprint

SF = "/root/testdata/sf0.001"


def pieces(text):
    return Counter((hashlib.sha256(p.encode()).digest()[:4], len(p)) for line in re.findall(r"[^\n]*\n|[^\n]+", text) for p in PIECE.findall(line))


def likeness(a, b):
    """Characters of the pieces that two texts share, over all; no tree."""
    if a == b:
        return 1.0
    one, other = pieces(a), pieces(b)
    shared = sum(n * key[1] for key, n in (one & other).items())
    return 2 * shared / (len(a) + len(b))


def plain(rows):
    """What each row in order gives; the next of the last row is the first."""
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        yield doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(text).hex(), fingerprint(changed).hex(), likeness(text, changed), likeness(text, following)


def held(frame):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in frame.collect()]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_whole_table(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        assert sorted(held(text_tree.fingerprints(docs.repartition(5))), key=lambda r: r[0]) == list(plain(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_repeats_and_clashing_names(spark):
    """Null ids come first, null texts are empty, repeated rows follow one another; other columns don't matter."""
    same = [(3, "Same words. And more.")] * 30
    rows = [(None, "first")] + [(1, "")] + same + [(4, "x" * 200_000), (5, "a\nb\n" * 9_000), (9, "last one")]
    frame = spark.createDataFrame([(d, t or None, 1, "p", 2, "f") for d, t in rows], "doc_id long, text string, hash int, part string, kind int, fingerprint string").repartition(4)
    got = sorted(held(text_tree.fingerprints(frame)), key=lambda r: repr(r[:3]))
    assert got == sorted(plain(rows), key=lambda r: repr(r[:3]))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(7, "Only one. Document here.")], "doc_id long, text string")
    assert held(text_tree.fingerprints(docs)) == list(plain([(7, "Only one. Document here.")]))
    assert text_tree.fingerprints(docs.limit(0)).collect() == []


@given(st.text(alphabet=" \n\t.!?#abé日", max_size=400), st.text(alphabet=" \n\t.!?#abé日", max_size=400))
def test_trees_of_any_texts(a, b):
    """Pieces make up the text; one root, one text; likeness is that of the pieces and alike both ways."""
    assert "".join(p for line in text_tree.LINE.findall(a) for p in PIECE.findall(line)) == a
    one, other = fingerprint(a), fingerprint(b)
    assert (one[:32] == other[:32]) == (a == b) and (one == other) == (a == b)
    near, spans = compare(one, other)
    assert near == pytest.approx(likeness(a, b)) == pytest.approx(compare(other, one)[0])
    assert all(0 <= x < y <= len(a) for x, y in spans)


def test_edits_are_found_and_move_nothing_else():
    draw = random.Random(2)
    lines = [" ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(draw.randint(5, 30))) + "." for _ in range(200)]
    text = "\n".join(lines)
    for k in (0, 77, 199):
        changed = [*lines]
        changed[k] = "Put in before. " + lines[k]
        near, spans = compare(fingerprint("\n".join(changed)), fingerprint(text))
        at = len("\n".join(changed[:k])) + (k > 0)
        assert near > 0.98 and all(at <= begin and end <= at + len(changed[k]) + 1 for begin, end in spans) and spans
    gone = lines[:50] + lines[51:]
    assert compare(fingerprint("\n".join(gone)), fingerprint(text))[1] == [] and compare(fingerprint(text), fingerprint("\n".join(gone)))[1] == [(len("\n".join(lines[:50])) + 1, len("\n".join(lines[:51])) + 1)]


def test_halves():
    assert edited("abcde", "XYZ") == "abcXY" and edited("abcdef", "X") == "abcX" and edited("a", "X") == "a" and edited("", "X") == ""


def test_near_values_tell_copies_from_others(spark):
    """Half of a text is kept, so about half is alike; unlike neighbours share next to nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 400")
    got = text_tree.fingerprints(docs).toPandas()
    assert 0.4 < got.near_edited.median() < 0.55 and got.near_next.median() < 0.05
    assert (got.near_edited >= 0).all() and (got[["near_edited", "near_next"]] <= 1).all().all()
