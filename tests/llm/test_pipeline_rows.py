"""The pipeline's stages judge rows: null and repeated ids, copies, clashing column names, empty tables; and site evidence."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenbank.llm import byte_bpe, common, decontaminate, quality_model, quality_rules, shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _other string, row int, node long, hash int, kept string, a int, t string, extra map<string,int>"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 2, 3, "y", 4, "z", {"k": 1}) for i, t, s in rows], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 8))) for _ in range(n))


def kept(df):
    return sorted(Counter((r.doc_id, r.text, r.source) for r in df.collect()).items(), key=str)


def test_near_copies_of_rows(spark):
    one, two, three = words(120, 1), words(120, 2), words(120, 3)
    near = one.rsplit(" ", 1)[0] + " changed"
    rows = [(5, one, "s"), (5, two, "s"), (1, near, "s"), (None, three, "s"), (None, three, "s"), (9, three, "s"), (7, two, "s"), (8, words(120, 4), "s"), (8, words(120, 4), "s"), (6, "", "s"), (6, None, "s"), (None, words(120, 5), "s")]
    got = simhash.keep_one(docs_of(spark, rows))
    assert got.columns == docs_of(spark, rows[:1]).columns
    # (5, one) goes for (1, near), (5, two) stays; of the equal rows with id 8 one stays, of the null ones none as 9 has that text.
    assert Counter((r.doc_id, r.text) for r in got.collect()) - Counter([(6, ""), (6, None)]) == Counter([(1, near), (5, two), (9, three), (8, words(120, 4)), (None, words(120, 5))])
    assert sum(r.doc_id == 6 for r in got.collect()) == 1
    assert simhash.keep_one(docs_of(spark, rows).limit(0)).count() == 0


def test_contaminated_rows(spark):
    item, clean = words(20, 6), words(300, 7)
    rows = [(5, f"{clean} {item} {words(50, 8)}", "s"), (5, clean, "s"), (None, item.upper(), "s"), (None, item.upper(), "s"), (None, clean, "s"), (1, None, "s"), (1, "", "s"), (2, "two words", "s"), (3, "so two  words, it is", "s")]
    bench = spark.createDataFrame([(1, item, 0), (None, "two words", 0), (2, None, 0), (3, "", 0)], "item_id long, text string, row int")
    got = decontaminate.drop_contaminated(docs_of(spark, rows), bench)
    assert kept(got) == kept(docs_of(spark, [rows[1], rows[4], rows[5], rows[6]]))
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()), key=str)
    assert found == sorted([(5, 1), (None, 1), (None, 1), (2, None), (3, None)], key=str)
    assert decontaminate.drop_contaminated(docs_of(spark, rows), bench.limit(0)).count() == len(rows)


def test_partitions_try_fewer(spark):
    items = [(i, words(n, 100 + i)) for i, n in enumerate([6] * 20 + [20] * 20 + [200] * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, words(n, i)) for i, n in enumerate([8] * 20 + [60] * 20 + [2_000] * 5)], "row long, text string")
    sketches = decontaminate.item_sketches(bench).cache()
    tried = decontaminate.tried(docs, sketches)
    most, parts = sketches.agg(F.max("hash"), F.count_distinct("part")).first()
    whole = docs.select(F.explode(F.array_distinct(decontaminate.shingle_hashes(decontaminate.hashed_words(decontaminate.words(F.col("text")))))).alias("h"))
    assert parts >= 3 and tried.count() < 0.7 * parts * whole.filter(F.col("h") <= most).count()
    small = tried.join(docs.filter("row < 20"), "row").filter("part > 2")
    assert small.count() == 0  # eight words can't hold a long item


def test_quality_rows(spark):
    good, bad = words(80, 9), "### $$$ %%% " * 40
    rows = [(i, words(60 + i, 20 + i), "s") for i in range(30)] + [(100 + i, bad + words(5, i), "s") for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(None, 0)], "doc_id long, quality int")
    asked = rows + [(5000, good, "s"), (5000, bad, "s"), (None, good, None), (None, bad, None), (None, bad, None), (5001, "", "s"), (5002, None, "s")]
    got = kept(quality_model.keep_good(docs_of(spark, asked), labels))
    assert got == kept(docs_of(spark, [*rows[:30], asked[60], asked[62]]))
    assert quality_model.keep_good(docs_of(spark, asked).limit(0), labels).count() == 0
    assert quality_model.keep_good(docs_of(spark, asked), labels.limit(0)).count() <= len(asked)


def test_quality_posteriors_match_brute_force(spark):
    """Hosts and paths that differ: posteriors as worked out by hand, without a row's own label, and decisions that they change."""
    r = random.Random(8)
    rates = {("good.org", "news"): 0.95, ("good.org", "wiki"): 0.9, ("bad.com", "forum"): 0.1, ("bad.com", "blog"): 0.3, ("mid.net", "x"): 0.5}
    rows, labels = [], []
    for i in range(600):
        (host, path), rate = r.choice(list(rates.items()))
        y = int(r.random() < rate)
        # The text tells a little.
        text = " ".join(r.choice(["#", "$", "%"]) * r.randint(0, 2) + w for w in words(40, i).split()) if r.random() < (0.45 if y else 0.55) else words(40, i)
        rows.append((i, text, f"https://{host}/{path}/page{i}"))
        if i % 3:
            labels.append((i, y))
    docs = docs_of(spark, rows)
    got = {x.doc_id: x for x in quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    label = dict(labels)
    site = {i: tuple(s.split("/")[2:4]) for i, _, s in rows}
    paths, hosts = {}, {}
    for i, y in labels:
        for d, k in ((paths, site[i]), (hosts, site[i][0])):
            n, good = d.get(k, (0, 0))
            d[k] = (n + 1, good + y)

    def weight(d):
        n, k = sum(x[0] for x in d.values()), sum(x[1] for x in d.values())
        mean = k / n
        spread = sum(x[1] ** 2 / x[0] for x in d.values()) / n - mean**2
        return max(1.0, min(1e4, mean * (1 - mean) / max(1e-6, spread - mean * (1 - mean) * len(d) / n)))

    overall = sum(y for _, y in labels) / len(labels)
    for i, _, _ in rows:
        y = label.get(i)
        out = (0, 0) if y is None else (1, y)
        host = (hosts[site[i][0]][1] - out[1] + weight(hosts) * overall) / (hosts[site[i][0]][0] - out[0] + weight(hosts))
        path = (paths[site[i]][1] - out[1] + weight(paths) * host) / (paths[site[i]][0] - out[0] + weight(paths))
        assert got[i].host_good == pytest.approx(host, rel=1e-9) and got[i].path_good == pytest.approx(path, rel=1e-9)
    changed = [i for i in got if (got[i].document_score >= 0.5) != got[i].kept]
    assert len(changed) > 50
    held = [i for i, _, _ in rows if i not in label]
    kept_share = {h: sum(got[i].kept for i in held if site[i][0] == h) / max(1, sum(site[i][0] == h for i in held)) for h in ("good.org", "bad.com")}
    assert kept_share["good.org"] > 0.9 and kept_share["bad.com"] < 0.2


def test_rules_keep_rows(spark):
    fine = ". ".join(words(12, s) for s in range(10))
    rows = [(1, fine, "s"), (1, "short", "s"), (None, fine, "s"), (None, None, "s"), (2, "", "s"), (1, fine, "s")]
    assert kept(quality_rules.keep_documents(docs_of(spark, rows))) == kept(docs_of(spark, [rows[0], rows[2], rows[5]]))
    assert quality_rules.keep_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_tokens_of_rows(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = byte_bpe.load_encoding(path, pattern)
    long = words(900, 3)
    rows = [(1, "one text", "s"), (1, "other text", "s"), (None, long, "s"), (None, long, "s"), (2, None, "s"), (2, "", "s")]
    got = Counter((r.doc_id, r.n_tokens) for r in byte_bpe.token_digests(docs_of(spark, rows), path, pattern, 1_000, 100).collect())
    assert got == Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t, _ in rows)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_by_stars_and_in_one_task(spark, few):
    """Chains, stars, loops and repeated edges: the same roots by rounds of stars and by one task."""
    import random

    from lumenbank.llm.graph import components

    draw = random.Random(few)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 30)] + [(7, 7), (5, 3), (3, 5), (5, 3)] + [(draw.randrange(3000, 3300), draw.randrange(3000, 3300)) for _ in range(160)] + [(-4, 9_000_000_000)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, top(x)) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), few).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_dense_group_of_edited_copies(spark):
    """Many edited copies of one text, most pairs of them near 0.8: groups are those of all links, found by comparing all pairs."""
    import random

    from lumenbank.llm import shingles

    draw = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(draw.randrange(1, 5)):
            words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long")
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    kept = {r.doc_id for r in shingles.keep_one(docs).collect()}
    assert kept == {i for i in range(len(texts)) if top(i) == i} and 1 < len(kept) < 110


def test_fingerprints_meet_before_shingles(spark, monkeypatch):
    """The first pairs that are checked are SimHash links and connect all of them; later ones lie between what they joined; groups are those of all pairs."""
    from lumenbank.llm import shingles

    draw = random.Random(5)
    texts = [words(400, s) for s in range(40)]
    for i in range(160):  # a few words changed at one place, or one in so many
        w = texts[i % 40].split()
        for k in range(draw.randrange(1, 5) if i % 3 else 25):
            w[50 + k if i % 2 else draw.randrange(400)] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, "one two", texts[0].upper()]
    sets = {shingles.set_key(h): h for h in (shingles.shingle_set(t) for t in texts)}
    marks = {n: sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h.tolist()) > len(h)) for n, h in sets.items()}
    apart = {(a, b): (marks[a] ^ marks[b]).bit_count() for a in sets for b in sets if a < b}
    alike = {(a, b) for a, b in apart if 9 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * (len(sets[a]) + len(sets[b]))}

    def groups(pairs):
        root = {n: n for n in sets}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return {n: top(n) for n in sets}

    asked, check = [], shingles.near_copies

    def near_copies(pairs, docs, nodes):
        asked.append([(r.a, r.b) for r in pairs.collect()])
        return check(pairs, docs, nodes)

    monkeypatch.setattr(shingles, "near_copies", near_copies)
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    first, later = asked[0], [p for pairs in asked[1:] for p in pairs]
    links = {p for p, bits in apart.items() if bits <= 6}
    assert set(first) <= links and groups(first) == groups(links) and len(first) < len(links)
    met = groups(alike & set(first))
    assert later and all(met[a] != met[b] for a, b in later)
    # Neither step alone would do here: SimHash misses links, and joins some that the other then need not ask.
    assert alike & set(first) and groups(alike & links) != groups(alike)
    of = [shingles.set_key(shingles.shingle_set(t)) for t in texts]
    whole = groups(alike)
    assert kept == {i for i, n in enumerate(of) if not any(whole[of[k]] == whole[n] for k in range(i))}


@pytest.mark.parametrize("few", [(50_000, 16 << 20), (50_000, 0), (0, 0)])
def test_few_pairs_take_few_tasks(spark, monkeypatch, few):
    """Over many shuffle partitions few pairs are read in one; whether sides are sent whole or shuffled, the same rows stay."""
    from lumenbank.llm import shingles

    draw = random.Random(3)
    texts = [words(60, 700 + s) for s in range(12)]
    for i in range(48):
        w = texts[i % 12].split()
        for k in range(1 + i % 3):
            w[draw.randrange(60) if i % 2 else 20 + k] = f"x{i}"
        texts.append(" ".join(w))
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    near = {(a, b) for b in range(len(sets)) for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    parts, check = [], shingles.near_copies

    def near_copies(pairs, docs, nodes):
        parts.append((pairs.rdd.getNumPartitions(), nodes.rdd.getNumPartitions()))
        return check(pairs, docs, nodes)

    monkeypatch.setattr(shingles, "near_copies", near_copies)
    for name, value in zip(("FEW_PAIRS", "FEW_BYTES"), few):
        monkeypatch.setattr(shingles, name, value)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts + texts[:5])])).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert kept == {i for i, r in enumerate(root) if i == r} and 12 <= len(kept) < len(texts)
    assert len(parts) >= 3 and set(parts) == {(1, 1)}


def test_search_of_a_dense_group_takes_little_memory():
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(1)
    values = np.full(4096, 0x123456789ABCDEF0, np.uint64)
    for _ in range(5):
        values ^= np.uint64(1) << r.integers(0, 64, len(values)).astype(np.uint64)
    values = np.unique(values).reshape(-1, 1)
    rows = np.arange(len(values))
    root, keys, children = simhash.build_forest(values, np.zeros(len(values), np.int64), rows)
    found = 0
    tracemalloc.start()
    for a, _ in simhash.search_forest(values, np.full(len(values), root[0]), rows, keys, children, 6):
        found += len(a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(int((np.bitwise_count(values ^ v) <= 6).sum()) - 1 for v in values[:, 0])
    assert peak < 40e6


def test_texts_go_to_workers_in_small_batches(spark):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 5000, "x").alias("text"))
    common.map_rows(docs, lambda: lambda i, t: [(i,)], "doc_id long")

    def size(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["doc_id"])

    sizes = docs.mapInArrow(size, "doc_id long").collect()
    assert len(sizes) >= 4 and max(r.doc_id for r in sizes) <= 2 * common.BATCH


def test_tried_pairs_are_known_by_their_ids(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (-5, 2**62), (0, 0)], "a long, b long")
    tried = spark.createDataFrame([(1, 2), (0, 0), (-5, 2**62), (2, 3)], "a long, b long")
    left = shingles.untried(pairs, tried)
    assert sorted(map(tuple, left.collect())) == [(1, 3), (2, 1)]
    # One long as the key: such a broadcast takes no memory pages.
    plans = []
    gathered, shingles.gathered = shingles.gathered, lambda df: plans.append(df) or df
    try:
        plan = shingles.untried(pairs, tried)._jdf.queryExecution().executedPlan().toString()
    finally:
        shingles.gathered = gathered
    assert plans and "HashedRelationBroadcastMode(List(input[0, bigint, false])" in plan
