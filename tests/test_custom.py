"""Operators without SQL against plain Python, and the rules that fixtures pin."""

from difflib import SequenceMatcher
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenbank.functions import custom as U
from lumenbank.functions import text as T
from lumenbank.operators import bank as B
from lumenbank.operators import checks as K
from lumenbank.operators import compose as C
from lumenbank.operators import mastery as M
from lumenbank.sources import sinks as S

SF = "/root/testdata/sf0.001"


def test_near_duplicate_stems(spark):
    from lumenbank.sources.adapters import bank

    got = {(r.first_id, r.second_id): r.ratio for r in entry.queries()["join20_near_duplicate_stems"](spark, SF).collect()}
    stems = {}
    for r in sorted(bank(spark, SF).collect(), key=lambda r: r.id):
        stems.setdefault(r.question, r.id)
    items = sorted((i, q) for q, i in stems.items())
    for (i, x), (j, y) in product(items, items):
        if i < j and abs(len(x) - len(y)) <= 0.35 * max(len(x), len(y)):
            ratio = SequenceMatcher(None, x, y).ratio()
            if ratio >= 0.9:
                assert got[i, j] == pytest.approx(ratio, abs=1e-6)
    assert got and all(r >= 0.82 for r in got.values())


def test_stems_at_the_ratio_itself(spark, monkeypatch):
    from lumenbank.plans import live

    r = np.random.default_rng(3)
    stems = ["abc", "abcd", "a", "ab", "", "two words", "two wordz"]
    for i in range(40):  # letters put in and changed, down to ratios around 0.82
        base = list(r.choice(list("abcdefghi   "), 40))
        other = list(base)
        for k in r.choice(38, 1 + i % 9, replace=False):
            other[k] = other[k] + "x" if i % 2 else "y"
        stems += ["".join(base), "".join(other)]
    rows = [(i, x) for i, x in enumerate(stems + stems[:6])]
    monkeypatch.setattr(live, "bank", lambda spark, sf: spark.createDataFrame(rows, "id long, question string"))
    got = {(x.first_id, x.second_id): x.ratio for x in live.near_duplicate_stems(spark, SF).collect()}
    want = {(i, len(stems) + i): 1.0 for i in range(6)}
    for (i, x), (j, y) in product(enumerate(stems), enumerate(stems)):
        ratio = SequenceMatcher(None, x, y).ratio()
        if i < j and abs(len(x) - len(y)) <= 0.35 * max(len(x), len(y)) and ratio >= 0.82:
            want[i, j] = pytest.approx(ratio, abs=1e-6)
    assert got == want and any(v < 0.9 for v in got.values())


def test_ratio_is_asked_where_it_may_be_reached(spark, monkeypatch):
    """The longest common subsequence bounds the ratio, so few pairs are matched block by block."""
    r = np.random.default_rng(4)
    texts = ["", "a", "\U0001f600ab"] + ["".join(r.choice(list("abcdefgh é"), r.integers(1, 90))) for _ in range(40)]
    texts += [x[:-3] + "zz" + x[:2] for x in texts[10:30]]
    asked, whole = [], U.SequenceMatcher
    monkeypatch.setattr(U, "SequenceMatcher", lambda *x: asked.append(x) or whole(*x))
    pairs = list(product(texts, texts))
    got = U.sequence_ratio_from(0.82).func(U.pd.Series([x for x, _ in pairs]), U.pd.Series([y for _, y in pairs]))
    want = [whole(None, x, y).ratio() for x, y in pairs]
    assert all(g == w if w >= 0.82 else g in (0, w) for g, w in zip(got, want))
    assert sum(w >= 0.82 for w in want) > 60 and len(asked) < len(pairs) / 5


def test_poisson_binomial(spark):
    chances = [0.25, 0.5, 0.75, 0.25]
    dist = np.zeros(5)
    for hits in product((0, 1), repeat=4):
        dist[sum(hits)] += np.prod([p if h else 1 - p for p, h in zip(chances, hits)])
    assert U.poisson_binomial(np.array(chances)) == pytest.approx(dist)
    rows = spark.createDataFrame([("k", p, h) for p, h in zip(chances, (1, 1, 1, 0))], "key string, chance double, hit int")
    got = U.tail_p_values(rows, "key", "chance", "hit").first()
    assert (got.n, got.hits) == (4, 3)
    assert got.p == pytest.approx(dist[dist <= dist[3] * (1 + 1e-9)].sum())


def test_seeded_shuffle_is_a_permutation(spark):
    rows = spark.createDataFrame([(list("abcdefgh"),), ([],), (["x"],)], "a array<string>")
    first, again = ([r[0] for r in rows.select(U.seeded_shuffle(F.col("a"), 5)).collect()] for _ in range(2))
    assert first == again and sorted(first[0]) == list("abcdefgh") and first[0] != list("abcdefgh")
    assert ((U.seeded_numbers(1, 50) >= 0) & (U.seeded_numbers(1, 50) < 1)).all()


def test_slugs(spark):
    one = spark.createDataFrame([("Économie & Finance",)], "t string")
    assert one.select(U.area_slug(F.col("t"))).first()[0] == "economie_and_finance"
    assert one.select(T.slug(F.lit("  A -- b! "))).first()[0] == "a-b"


def log_of(spark, rows):
    kind = "id long, ts timestamp, user_id long, cluster string, area string, pi string, question_id string, difficulty string, chosen string, correct boolean, elapsed_ms long"
    from datetime import datetime

    return spark.createDataFrame([(i, datetime(2024, 1, 1, 0, t), 1, "c", "a", p, q, d, ch, ok, ms) for i, t, p, q, d, ch, ok, ms in rows], kind)


def test_equal_times_and_unseen(spark):
    log = log_of(spark, [(1, 0, "p", "q1", "medium", "A", True, 10), (2, 0, "p", "q1", "medium", "B", False, 10), (3, 5, "p", "q2", "easy", None, False, 10)])
    ranks = {r.id: r.recency for r in M.ranked(log).collect()}
    assert ranks == {3: 0, 1: 1, 2: 2}  # equal times: the earlier logged is the newer
    errors = {r.question_id: r for r in M.error_log(log).collect()}
    assert not errors["q1"].resolved and errors["q1"].chosen == "B"
    assert errors["q2"].pattern == "missed"  # skipped, though easy and quick
    shelf = spark.createDataFrame([("c", "a", "p"), ("c", "a", "new")], "cluster string, area string, pi string")
    stats = {r.pi: r for r in M.universe_stats(log, shelf).collect()}
    assert stats["new"].mastery == 0.0 and not stats["new"].seen
    weak = {r.pi: r.weakness for r in M.weakest(M.universe_stats(log, shelf)).collect()}
    assert weak["new"] == 0.55
    assert M.pi_stats(log.limit(0)).count() == 0


@pytest.mark.parametrize("n", [7, 8, 9])
def test_thresholds_need_eight(spark, n):
    log = log_of(spark, [(i, i, "p", f"q{i}", "easy", "A", True, 1000 * (i + 1)) for i in range(n)])
    want = 12_000.0 if n < 8 else float(np.median([1000 * (i + 1) for i in range(n)]))
    assert M.thresholds(log).first().easy_ms == want


@pytest.mark.parametrize("n", [14, 15])
def test_day_best_only_beyond_fourteen(spark, n):
    from datetime import datetime

    points = spark.createDataFrame([(1, "c", i, datetime(2024, 1, 1 + i // 5, i), 0.5) for i in range(n)], "user_id long, cluster string, id long, ts timestamp, readiness double")
    assert M.day_best(points).count() == (n if n <= 14 else 3)


def test_patch_tells_null_from_absent(spark):
    target = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id long, ended string, n int")
    patches = spark.createDataFrame([(1, None, True, 9, False)], "id long, ended string, set_ended boolean, n int, set_n boolean")
    got = {r.id: (r.ended, r.n) for r in S.patch(target, patches, "id", ["ended", "n"]).collect()}
    assert got == {1: (None, 5), 2: ("y", 6)}
    again = S.insert_ignore(target, target.withColumn("n", F.lit(0)), ["id"], ["n"])
    assert sorted(r.n for r in again.collect()) == [5, 6]


def test_quota_ties(spark):
    rows = spark.createDataFrame([("g", x, 1, 4) for x in "abc"], "g string, area string, n int, total int")
    got = {r.area: r.quota for r in B.largest_remainder(rows, ["g"], "n", "total", "area").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_borrowing_fills_short_tiers(spark):
    rows = spark.createDataFrame([(i, "g", "easy" if i < 9 else "hard") for i in range(10)], "id long, g string, difficulty string")
    got = C.compose_test(rows, {"easy": 2, "medium": 2, "hard": 2}, "g", 1).collect()
    assert len(got) == 6 and sum(r.borrowed for r in got) == 3


def test_findings_and_outcomes(spark):
    rows = spark.createDataFrame([(1, {"A": "x", "B": "x", "C": "always so", "D": ""}, "E")], "id long, options map<string,string>, answer string")
    assert {r.finding for r in K.findings(rows, K.option_gates()).collect()} == {"empty option", "equal options", "no key", "absolute"}
    returns = spark.createDataFrame([(1, "a", "HARD"), (1, "b", "MEDIUM"), (2, "a", "HARD"), (2, "b", "HARD"), (3, "a", "DEFECTIVE"), (3, "b", "HARD")], "cand_id long, rater string, verdict string")
    assert {r.cand_id: r.outcome for r in B.reconcile(returns).collect()} == {1: "split", 2: "agreed_hard", 3: "defective"}


def test_longest_run_of_one_document(spark):
    text = "one two three four five six seven eight nine ten"
    published = spark.createDataFrame([(1, text)], "unit long, text string")
    corpus = spark.createDataFrame([(7, "x " + text[:27]), (8, text[14:] + " y")], "doc long, text string")
    run = B.longest_runs(B.ngram_matches(published, corpus, 3, 5), 3).collect()
    assert [(r.unit, r.doc, r.start, r.words) for r in run] == [(1, 8, 3, 7)]


def test_rest_stands_without_the_corpus_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "lumenbank"), tmp_path / "lumenbank", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg02_pi_stats' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_packing(spark):
    from lumenbank.operators import packing as P

    areas = spark.createDataFrame([("c", "a", 25), ("c", "b", 4), ("c", "d", 7), ("c", "e", 6)], "cluster string, area string, n long")
    got = sorted((r.area, r.part, r.chunk, r.n) for r in P.next_fit(areas, "cluster", 10).collect())
    assert got == [("a", 0, 1, 9), ("a", 1, 2, 8), ("a", 2, 3, 8), ("b", 0, 4, 4), ("d", 0, 5, 7), ("e", 0, 6, 6)]
    bins = P.first_fit_decreasing(areas, "cluster", 10).collect()
    assert sum(r.n for r in bins) == areas.groupBy().sum("n").first()[0]
    full = {}
    for r in bins:
        full[r.bin] = full.get(r.bin, 0) + r.n
    assert max(full.values()) <= 10 and any(r.part for r in bins)


def test_acceptance_grows_the_shelf(spark):
    from lumenbank.operators import packing as P

    rows = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["a", "b"]), ("s", 3, ["c"]), ("s", 4, ["d"])], "shelf string, id long, words array<string>")
    got = {r.id: (r.accepted, r.nearest) for r in P.accept_in_order(rows, "shelf", 0.5, 2).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, 1), 4: (False, 1)}


def test_binomial_tails_of_many_trials(spark):
    rows = spark.createDataFrame([("k", 0.25, i % 4 == 0) for i in range(4_000)] + [("k", 0.5, i % 2 == 0) for i in range(3_000)] + [("k", 1.0, True)] * 5, "key string, chance double, hit boolean").withColumn("hit", F.col("hit").cast("int"))
    got = U.tail_p_values(rows, "key", "chance", "hit").first()
    exact = U.poisson_binomial(np.array([0.25] * 4_000 + [0.5] * 3_000 + [1.0] * 5))
    assert (got.n, got.hits) == (7_005, 2_505)
    assert got.p == pytest.approx(exact[exact <= exact[2_505] * (1 + 1e-9)].sum())
    x, y = U.binomial(900, 0.5)[1], U.binomial(700, 0.25)[1]
    direct, U.DIRECT = U.convolved(x, y), 1
    assert U.convolved(x, y) == pytest.approx(direct, abs=1e-14)
    U.DIRECT = 400_000_000


def test_trajectory_has_no_cut(spark):
    """Over a thousand attempts of one indicator, against the plain recursion."""
    from lumenbank.operators import mastery as M

    n = 1_100
    rows = [(i, i, 1, "c", "a", "p", "medium", i % 3 == 0) for i in range(n)]
    log = spark.createDataFrame(rows, "id long, at long, user_id long, cluster string, area string, pi string, difficulty string, correct boolean").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    universe = spark.createDataFrame([("c", "a", "p")], "cluster string, area string, pi string")
    blueprint = spark.createDataFrame([("a", 1.0)], "area string, weight double")
    got = [r.readiness for r in M.trajectory(log, universe, blueprint).orderBy("ts").collect()]
    s = c = 0.0
    w = M.WEIGHTS["medium"] if isinstance(M.WEIGHTS, dict) else 1.0
    for i in range(n):
        s, c = w + M.DECAY * s, w * (i % 3 == 0) + M.DECAY * c
        assert got[i] == pytest.approx(min(1.0, s / M.FULL) * (M.PRIOR_HITS + c) / (M.PRIOR + s), rel=1e-12)


def test_option_orders(spark):
    import __spark_entry__ as entry

    got = entry.queries()["ord03_exact_shuffle"](spark, "/root/testdata/sf0.001").collect()
    for r in got:
        values = list("ABCD")
        for i, u in zip(range(3, 0, -1), U.seeded_numbers(r.id + 42, 4)):
            j = int(u * (i + 1))
            values[i], values[j] = values[j], values[i]
        assert r.letters == "".join(values)


def test_area_slugs_of_whole_texts(spark):
    import unicodedata

    import __spark_entry__ as entry

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in entry.queries()["str04_area_slug"](spark, "/root/testdata/sf0.001").collect():
        if texts[r.doc_id] is not None:
            plain = "".join(x for x in unicodedata.normalize("NFKD", texts[r.doc_id] + " & more") if not unicodedata.combining(x)).replace("&", " and ").lower()
            assert r.slug == "_".join(x for x in __import__("re").split("[^a-z0-9]+", plain) if x)


def test_weighted_sample(spark):
    from lumenbank.operators import retrieval as R

    rows = spark.range(4_000).select("id", F.when(F.col("id") < 3_000, "x").otherwise("y").alias("cluster"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("weight")).repartition(6)
    got = R.weighted_sample(rows, 200, 3).collect()
    assert sum(r.cluster == "x" for r in got) == sum(r.cluster == "y" for r in got) == 200 and len({r.id for r in got}) == 400
    assert sum(r.weight == 9.0 for r in got) > 320


def test_absent_slices_and_fields_raise(spark):
    from lumenbank.operators import retrieval as R

    rows = spark.createDataFrame([(1, "c", "l", "sets")], "id long, cluster string, level string, section string")
    with pytest.raises(LookupError):
        R.scan_slice(rows, "c", "l", "pools")
    with pytest.raises(Exception, match="no ordinal"):
        R.shelf_order(spark.createDataFrame([("s", "plain")], "shelf string, id string")).collect()
    with pytest.raises(Exception, match="no area"):
        R.payload_identity(spark.createDataFrame([(1, None)], "id long, difficulty string"), spark.createDataFrame([(1, None, "easy")], "id long, area string, difficulty string"), {"area": "area"}, ["difficulty"]).collect()
