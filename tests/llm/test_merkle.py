"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from itertools import groupby

import pytest

from lumenbank.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int, tree string, proof string, size long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield i % 16, run[: i % 16] + run[i % 16 + 1 :]
        i //= 16


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    by_source = lambda r: (r[1] is not None, (r[1] or "").encode())
    rows = sorted(rows, key=lambda r: (by_source(r), r[0] is not None, r[0] or 0, leaf_of(*r)))
    groups = [list(g) for _, g in groupby(rows, by_source)]
    trees = [tree([leaf_of(*r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    for k, (group, t) in enumerate(zip(groups, trees)):
        for i, r in enumerate(group):
            proof = [*path(t, i), *path(top, k)]
            now = t[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf_of(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for at, beside in proof:
                now = digest("".join([*beside[:at], now, *beside[at:]]))
            yield r[0], t[0][i], t[-1][0], top[-1][0], digest("".join("".join(b) for _, b in proof)), now, now == top[-1][0]


def found(spark, rows):
    frame = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 1, "y", "z", 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.verified(frame).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [256, 1], [257, 16, 1, 3], [2] * 17, [700, 1, 1]])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(i, f"s{k}", "en", i, f"Text {i} ÉA") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    got = found(spark, rows)
    assert got == sorted(plain(rows), key=repr)
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_nulls_repeats_and_clashing_names(spark):
    """Null sources are one source, first; null ids first; repeated rows are leaves of their own; empty and long texts."""
    rows = [(None, None, None, None, None)] * 20 + [(5, None, "de", 1, "A")] * 18 + [(7, "", None, 0, ""), (7, "b", None, 0, "B" * 300_000), (None, "é", "fr", 3, "Ab"), (0, "z", "en", None, "lower")]
    assert found(spark, rows) == sorted(plain(rows), key=repr)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_proof_fails_for_another_leaf(spark):
    rows = spark.createDataFrame([(i, "T", "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(rows).limit(3).collect()
    for r in made:
        steps = spark.createDataFrame([(r.leaf, r.proof), (made[0].leaf[::-1], r.proof)], "digest string, proof array<struct<before:int,digests:string>>")
        roots = [x[0] for x in steps.select(merkle.fold(steps.digest, steps.proof)).collect()]
        assert roots[0] == r.root != roots[1]
