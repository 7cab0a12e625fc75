"""Cross-tokenizer alignment against the libraries and plain loops over tokens."""

import hashlib
import os
import random
from collections import Counter
from itertools import product

import public_tokenizers
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
import sentencepiece  # noqa: E402
import tokenizers  # noqa: E402

from lumenbank.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a long, row long, pairs string, key long"


@pytest.fixture(scope="module")
def libraries():
    first = tokenizers.Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, libraries):
    """The groups of a text as lists of (A ids, B ids), by walking both sequences; none where the bytes differ."""
    first, second = libraries
    if not text:
        return []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != b" " + text.encode() for side in (a, b)):
        return []
    ends = [set(), set()]
    for side, seen in zip((a, b), ends):
        at = 0
        for _, raw in side:
            at += len(raw)
            seen.add(at)
    out, both = [], ends[0] & ends[1]
    for k, side in enumerate((a, b)):
        at, group = 0, 0
        for i, raw in side:
            if group == len(out):
                out.append(([], []))
            out[group][k].append(i)
            at += len(raw)
            group += at in both
    return out


def plain(rows, libraries):
    made = [(doc, groups_of(text, libraries)) for doc, text in rows]
    links = [[x for a, b in groups for x in product(a, b)] for _, groups in made]
    counts = Counter(pair for one in links for pair in set(one))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for (doc, groups), one in zip(made, links):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        yield doc, n_a, n_b, len(groups), len(one), sum(counts[x] == best[x[0]] for x in one), sum(counts[x] for x in one), hashlib.sha256(written.encode()).hexdigest() if groups else ""


def texts():
    draw = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\x00", "\x1c", " ", "​", "the", " The", "naïve", "don't", "<|endoftext|>", "<s>", "<0x41>", "▁", "日本語", "\U0001f600", "ﬁ", "123", "....", "é", "word ", " thattion", "aaaa", "Größe"]
    made = ["".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(300)]
    return made + ["", None, "a", " ", "the the the", "the the the", "x" * 3_000, " " * 500 + "y", "ab" * 700 + "\n" * 99, "long word and more " * 9_000]


@pytest.mark.parametrize("mapped", [True, False])
def test_against_plain_loops(spark, libraries, mapped):
    rows = [(i % 100 if i % 50 else None, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in alignment.scored(frame, A, B, mapped).select(*alignment.RESULT).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, libraries), key=repr)


def test_groups_beyond_the_limits(spark, libraries, monkeypatch):
    """Large groups are counted by their distinct ids, and texts with many links a part at a time, with the same result."""
    rows = [(i, t) for i, t in enumerate(texts()[-8:]) if t]
    first, second = alignment.byte_level(A), alignment.pieces(B)
    for _, t in rows:
        ids = first.ids(" " + t, b" " + t.encode()), second.ids(t, b" " + t.encode())
        if ids[1] is None:
            continue
        groups = alignment.Groups(*ids, first.size, second.size)
        held = Counter((x, y) for a, b in groups_of(t, libraries) for x, y in product(a, b))
        for limits in ((4_000_000, 65_536), (50, 3), (7, 1)):
            monkeypatch.setattr(alignment, "LINKS", limits[0])
            monkeypatch.setattr(alignment, "GROUP", limits[1])
            keys, times = alignment.unpack(alignment.pack(*groups.pairs()))
            assert {(k >> alignment.SHIFT, k & ((1 << alignment.SHIFT) - 1)): n for k, n in zip(keys.tolist(), times.tolist())} == held
            assert (keys[1:] > keys[:-1]).all()


def test_ids_are_the_library_s(libraries):
    ours, draw = alignment.byte_level(A), random.Random(9)
    points = [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x85, 0xFEFF, 0x180E, 0x1F600, 0x0E01, 0x093E]
    for _ in range(4_000):
        text = "".join(map(chr, draw.choices(points, k=draw.randint(1, 14))))
        assert ours.encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_partial_counts_are_handed_on_in_full(spark, monkeypatch):
    """Small limits in the worker and several partitions: the sums of all partial counts are the counts."""
    monkeypatch.setattr(alignment, "SORTED", 50)
    monkeypatch.setattr(alignment, "HELD", 10)
    docs = spark.createDataFrame([(i, f"some words {i % 7} and more") for i in range(200)], "doc_id long, text string").repartition(4)
    aligned = alignment.saved(alignment.align(docs, A, B))
    held = Counter(k for r in aligned.collect() for k in alignment.unpack(r.pairs)[0].tolist())
    partial = alignment.pair_counts(aligned).cache()
    assert partial.count() > 4 * len(held)
    totals = alignment.total_counts(partial).collect()
    assert {r.key: r.n for r in totals} == held and len(totals) == len(held)


def test_run_sums_over_batches():
    import pyarrow as pa

    keys, counts = [1, 1, 2, 5, 5, 5, 5, 9], [1, 2, 3, 4, 5, 6, 7, 8]
    for cut in range(1, 9):
        batches = [pa.RecordBatch.from_pydict({"key": keys[k : k + cut], "n": counts[k : k + cut]}) for k in range(0, 8, cut)]
        got = [(k, n) for b in alignment.run_sums(batches) for k, n in zip(*(c.to_pylist() for c in b.columns))]
        assert got == [(1, 3), (2, 3), (5, 22), (9, 8)]


@pytest.mark.parametrize("mapped", [True, False])
def test_no_rows_and_no_tokens(spark, mapped):
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.scored(none, A, B, mapped).count() == 0
    got = alignment.scored(spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string"), A, B, mapped).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")} and len(got) == 3
