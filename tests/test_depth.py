"""Operators with an algorithm of their own against plain loops."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lumenbank.operators import decks, leakage, matching

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi pi rho sigma tau".split()


# Decks


def plain_decks(terms, layout, cap, every):
    """Decks one after the other, with one cursor for each area."""
    areas, cursor, out = {}, {}, {}
    tiers = {}
    for area, i, slug, difficulty in sorted(terms, key=lambda t: t[1]):
        tiers.setdefault((area, difficulty), []).append((i, slug))
    for (area, difficulty), rows in tiers.items():
        areas.setdefault(area, []).extend((round((k + 0.5) / len(rows), 9), difficulty, i, slug) for k, (i, slug) in enumerate(rows))
    areas = {a: [(i, slug) for _, _, i, slug in sorted(rows)] for a, rows in areas.items()}
    for deck in sorted({d for d, *_ in layout}, key=lambda d: next(x[1] for x in layout if x[0] == d)):
        lines = {2: [], 3: []}
        for _, _, area, tier, _ in sorted((x for x in layout if x[0] == deck), key=lambda x: x[4]):
            rows = areas.get(area, [])
            at = cursor.get(area, 0) % len(rows) if rows else 0
            lines[tier].append([(area, *r) for r in rows[at:] + rows[:at]])
        turns = {t: [x[k] for k in range(max(map(len, ls), default=0)) for x in ls if k < len(x)] for t, ls in lines.items()}
        drawn, two, three = [], turns[2], turns[3]
        while two or three:
            drawn += two[:every] + three[:1]
            two, three = two[every:], three[1:]
        seen, kept = set(), []
        for area, i, slug in drawn:
            cursor[area] = cursor.get(area, 0) + 1
            if slug not in seen:
                seen.add(slug)
                kept.append((i, slug, area))
            if len(kept) >= cap:
                break
        out[deck] = kept
    return out


@pytest.mark.parametrize("cap, slugs", [(10, 400), (25, 40), (60, 25), (5, 4)])
def test_decks_follow_one_another(spark, cap, slugs):
    draw = random.Random(cap)
    terms = [(f"a{draw.choice([0, 0, 0, 1, 2, 3, 4])}", i, f"s{draw.randrange(slugs)}", draw.choice(["easy", "hard", "medium"])) for i in range(220)]
    layout = [(f"d{d}", d, f"a{a}", 2 if (a + d) % 2 else 3, a) for d in range(9) for a in range(6) if (a * d) % 4 != 3]
    frame = decks.spread_by_tier(spark.createDataFrame(terms, "area string, id long, slug string, difficulty string"))
    got = decks.compose(frame, spark.createDataFrame(layout, "deck string, deck_order long, area string, tier int, area_order long"), cap, 3).collect()
    want = {(d, k + 1, *row) for d, rows in plain_decks(terms, layout, cap, 3).items() for k, row in enumerate(rows)}
    assert {(r.deck, r.place, r.id, r.slug, r.area) for r in got} == want and len(got) == len(want)


# The most similar other row


def plain_best(rows):
    for shelf, i, words in rows:
        best, other = 0.0, None
        for s, j, w in sorted(rows, key=lambda r: r[1]):
            a, b = set(words or []), set(w or [])
            if s == shelf and j != i and a & b and len(a & b) / len(a | b) > best:
                best, other = len(a & b) / len(a | b), j
        yield shelf, i, other, best


def matched(spark, rows):
    return sorted(map(tuple, matching.best_other(spark.createDataFrame(rows, "shelf string, id long, words array<string>")).collect()))


def test_best_other_row(spark):
    """Frequent words, words of all rows, copies, rows alone on a shelf and rows without words."""
    draw = random.Random(6)
    weights = [2 ** (8 - k / 2) for k in range(len(WORDS))]
    rows = [(f"s{i % 3}", i, draw.choices(WORDS, weights, k=draw.randint(0, 7)) + ["x"] * (i % 3 == 1)) for i in range(240)]
    rows += [("s0", 900 + i, WORDS[:3]) for i in range(20)] + [("alone", 1000, ["x"]), ("none", 1001, None), ("none", 1002, [])]
    assert matched(spark, rows) == sorted(plain_best(rows))


def test_a_word_of_a_third_of_all_rows(spark):
    """Rows that share one frequent word and nothing else find the smallest of them, beyond the first block too."""
    rows = [("s", i, ["hot", f"own{i}"] + [f"more{i}-{k}" for k in range(5 - i % 5)]) for i in range(150)] + [("s", 500 + i, [f"lonely{i}"]) for i in range(50)]
    rows += [("s", 700 + i, ["hot", "warm"] + [f"w{i}-{k}" for k in range(12)]) for i in range(40)]
    assert matched(spark, rows) == sorted(plain_best(rows))


def test_copies_and_few_words_meet_in_few_rows(spark, monkeypatch):
    """Shelves of copies, of few words, and of both beside long rows: the best other row, and no pairs of copies or of rows that share a word on the way."""
    draw = random.Random(8)
    rows = [("copies", i, [WORDS[i % 5], WORDS[7 + i % 2], "x", None]) for i in range(300)] + [("copies", 990, ["own"]), (None, 991, ["x"]), (None, 992, ["x"])]
    rows += [("few", i, draw.choices(WORDS, k=draw.randint(0, 4)) + ["hot"]) for i in range(400)] + [("few", 900 + i, [f"o{i}"] * (1 + i % 2)) for i in range(9)]
    rows += [("wide", i, draw.choices(WORDS, k=draw.choice([0, 1, 2, 3, 9]))) for i in range(150)]
    kept, save = [], matching.saved
    monkeypatch.setattr(matching, "saved", lambda df: kept.append(save(df)) or kept[-1])
    want = [(*r[:2], None, 0.0) if r[0] is None else r for r in plain_best([(s, i, [w for w in words if w]) for s, i, words in rows])]
    got = matching.best_other(spark.createDataFrame(rows, "shelf string, id long, words array<string>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert max(df.filter("shelf = 'copies'").count() for df in kept if "shelf" in df.columns) <= 11
    assert max(df.filter("shelf = 'few'").count() for df in kept if "shelf" in df.columns) <= 409


def test_best_part_without_a_name(spark, tmp_path):
    """A part with a null among its words has none, as in SQL."""
    import __spark_entry__ as entry

    parts = [(1, "red bolt", "b", "SMALL", 1), (2, None, "b", "SMALL", 1), (3, "red nut", "b", "SMALL", None), (4, "red nut", "b", "SMALL", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["join21_best_part"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("b", 1, 4, 0.333333), ("b", 2, None, 0.0), ("b", 3, None, 0.0), ("b", 4, 1, 0.333333)]


def test_blocks(spark):
    places = [0, 15, 16, 63, 64, 255, 256, 1023, 1024]
    got = spark.createDataFrame([(p,) for p in places], "p long").select(matching.block_of(F.col("p")).alias("b")).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


# Runs over narrowing documents


def plain_runs(units, corpus, catalogue, n, most):
    def grams(text):
        words = text.split()
        return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]

    index = {}
    for doc, text in corpus:
        for g in grams(text):
            index.setdefault(g, set()).add(doc)
    for _, text in catalogue:
        for g in grams(text):
            index.pop(g, None)
    for unit, text in units:
        run = None
        for i, g in enumerate(grams(text)):
            docs = index.get(g, set())
            if not docs or len(docs) >= most:
                continue
            if run and i == run[1] + 1 and run[2] & docs:
                run = [run[0], i, run[2] & docs]
            else:
                if run:
                    yield unit, run[0], run[1] - run[0] + n, tuple(sorted(run[2]))
                run = [i, i, docs]
        if run:
            yield unit, run[0], run[1] - run[0] + n, tuple(sorted(run[2]))


def test_runs_stay_within_one_document(spark):
    """Neighbouring matches of three documents aren't one run; the catalogue's phrases are no leak; frequent ones neither."""
    draw = random.Random(8)
    text = [draw.choice(WORDS) for _ in range(120)]
    piece = lambda a, b: " ".join(text[a:b])
    units = [(1, " ".join(text)), (2, piece(10, 40) + " unlike words " + piece(60, 80)), (3, "nothing shared here at all")]
    corpus = [(10, piece(0, 30)), (11, piece(25, 70)), (12, piece(50, 120) + " tail"), (13, piece(90, 100)), (14, piece(92, 99)), (15, piece(92, 100)), (16, "short")]
    catalogue = [(1, piece(60, 66))]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    for n, most in ((4, 9), (3, 4), (5, 3)):
        found = leakage.matches(frame(units, "unit"), frame(corpus, "doc"), frame(catalogue, "doc"), n, most)
        got = leakage.narrowing_runs(found, n).collect()
        assert sorted((r.unit, r.start, r.words, tuple(r.docs)) for r in got) == sorted(plain_runs(units, corpus, catalogue, n, most))
        worst = {r.unit: r for r in leakage.report(leakage.narrowing_runs(found, n), 20).collect()}
        assert all(worst[u].failed == (worst[u].words >= 20) and worst[u].words == max(r.words for r in got if r.unit == u) for u in worst)
