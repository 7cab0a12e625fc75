"""Language ID, toxicity, SimHash, quality classifier, decontamination and the pipeline: brute force, held-out accuracy and edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenbank.llm import decontaminate, graph, language_id, quality_model, quality_rules, queries, simhash, toxicity
from lumenbank.llm.common import table, training_half

SF = "/root/testdata/sf0.01"


def docs_of(spark, rows, extra="kept string, node long, w string"):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", 0, "y") for r in rows], f"doc_id long, text string, lang string, source string, {extra}")


def texts(n, seed=0, words=60, vocabulary=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n)]


# Language ID


def test_language_held_out(spark):
    found = queries.op3_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_kneser_ney_sums_to_one(spark):
    train = docs_of(spark, [(1, "abba baab cab", "x", "s"), (2, "bccb acca", "y", "s"), (3, None, "x", "s"), (4, "zz", None, "s")])
    model = language_id.fit(train)
    assert model.langs == ["x", "y"]
    kinds = range(language_id.MASK + 1)
    for head in (0, 1, ord("a"), (1 << 15) | ord("b"), (ord("a") << 15) | ord("q")):
        grams = np.array([(head << 15) | k for k in kinds], np.int64)
        total = np.exp(model.arrays.score_grams(grams, language_id.ORDER)).sum(axis=0)
        assert total == pytest.approx([1, 1], abs=2e-3)


def test_kneser_ney_of_the_table_sums_to_one(spark):
    """Every gram of the training texts is kept, so each context's probabilities are whole."""
    train = table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(train)
    assert model.table.filter(f"n = {language_id.ORDER}").count() == language_id.gram_counts(train).count()
    heads = [r.context for r in model.table.filter(f"n = {language_id.ORDER}").select("context").distinct().orderBy(F.xxhash64("context")).limit(12).collect()]
    for head in heads:
        grams = np.array([(head << 15) | k for k in range(language_id.MASK + 1)], np.int64)
        assert np.exp(model.arrays.score_grams(grams, language_id.ORDER).astype(float)).sum(axis=0) == pytest.approx([1] * len(model.langs), abs=2e-3)


def test_large_models_are_joined(spark, monkeypatch):
    train = docs_of(spark, [(i, t, "x", "s") for i, t in enumerate(texts(20))] + [(100 + i, t.upper().replace("A", "É"), "y", "s") for i, t in enumerate(texts(20, 5))])
    asked = docs_of(spark, [(1, None, None, None), (2, "", "x", "s"), (3, "12 ?!", "x", "s"), (4, texts(1)[0] * 50, "y", "s"), (5, "日本語", "y", "s"), (5, "日本語", "y", "s"), (6, texts(1, 9)[0].replace("a", "é"), "y", "s")])
    rows = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 4), r.rejected, round(r.cross_entropy or 0, 3)) for r in language_id.predict(asked, language_id.fit(train)).collect())
    small = rows()
    monkeypatch.setattr(language_id, "CELLS", 10)
    assert rows() == small and len(small) == 7


def test_unseen_letters_are_rejected(spark):
    train = docs_of(spark, [(1, "abba baab cab abba cab", "x", "s"), (2, "bccb acca bccb acca", "y", "s")])
    asked = docs_of(spark, [(1, "щщщщ жжжж щжщж щщжж", "x", "s"), (2, "abba baab cab", "x", "s")])
    assert [r.rejected for r in language_id.predict(asked, language_id.fit(train)).orderBy("doc_id").collect()] == [True, False]


def test_language_edges(spark):
    train = docs_of(spark, [(i, t, "x", "s") for i, t in enumerate(texts(20))] + [(100 + i, t.upper().replace("A", "É"), "y", "s") for i, t in enumerate(texts(20, 5))])
    model = language_id.fit(train)
    asked = docs_of(spark, [(1, None, None, None), (2, "", "x", "s"), (3, "12 ?!", "x", "s"), (4, texts(1)[0] * 500, "y", "s"), (4, "日本語", "y", "s"), (4, "日本語", "y", "s")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(asked, model).collect()]
    assert {g[1:] for g in got if g[0] < 4} == {("und", 0.0)}
    assert len(got) == 6 and got[3][1] == "x" and all(0 <= g[2] <= 1 for g in got)
    assert language_id.predict(asked.limit(0), model).count() == 0
    empty = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(asked, empty).collect()} == {"und"}


# Toxicity


def test_kernel_is_the_subsequence_kernel():
    def slow(a, b):
        def features(w):
            w, out = f"^{w}$", {}
            for i in range(len(w)):
                for j in range(i + 1, min(i + toxicity.SPAN, len(w))):
                    for k in range(j + 1, min(i + toxicity.SPAN, len(w))):
                        key = w[i] + w[j] + w[k]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return out

        x, y = features(a), features(b)
        dot = sum(v * y.get(k, 0) for k, v in x.items())
        return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    words = ["idiot", "idxiot", "table", "id"]
    got = toxicity.kernel(words, toxicity.dense(["idiot", "moron"]))
    for i, w in enumerate(words):
        assert got[i] == pytest.approx([slow(w, "idiot"), slow(w, "moron")], abs=1e-3)
    assert got[1, 0] > 0.4 > got[2, 0]


def test_toxicity_finds_gapped_insults(spark):
    some = texts(480, 3)
    clean, plain, r, bad = some[:400], some[460:], random.Random(6), []
    for t in some[400:460]:
        words = t.split()
        for insult in ("grobleck", "snurfing", "zwapulous", "grobleck"):
            words.insert(r.randrange(len(words)), insult)
        bad.append(" ".join(words))
    docs = docs_of(spark, [(i, t, "x", "s") for i, t in enumerate(clean + bad)])
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(460)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    asked = docs_of(spark, [(0, plain[0], "x", "s"), (1, plain[1] + " gro-bleck and snurf1ng and zwapxulous", "x", "s"), (2, None, "x", "s"), (3, "", "x", "s"), (4, plain[2] + " g r o b l e c k s n u r f i n g zwapulous snurfing", "x", "s"), (4, "....", "x", "s")])
    got = [(r.doc_id, r.predicted) for r in toxicity.score(asked, model).collect()]
    assert got == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 1), (4, 0)]
    assert toxicity.score(asked.limit(0), model).count() == 0
    flat = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(asked, flat).collect()} == {0}


# SimHash


def slow_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=3):
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs]
    for i in range(60):  # near copies of one document, empty texts and ties
        words = docs[3].text.split()
        words[i * 5 % len(words)] = f"w{i}"
        rows.append((1000 + i, " ".join(words), "x", "s"))
    rows += [(2000, None, "x", "s"), (2001, "", "x", "s"), (2002, " \n", "x", "s"), (2003, "ONE two", "x", "s"), (2004, "one TWO", "x", "s"), (2004, "one TWO", "x", "s")]
    got = simhash.near_duplicates(docs_of(spark, rows)).select("doc_id", simhash.fingerprint_hex(F.col("signature")).alias("h"), "component_id").collect()
    values = {r[0]: slow_fingerprint(r[1]) for r in rows}
    want = slow_components(values)
    assert sorted((r.doc_id, r.h, r.component_id) for r in got) == sorted((r[0], format(values[r[0]], "016x"), want[r[0]]) for r in rows)
    assert simhash.near_duplicates(docs_of(spark, rows[:1]).limit(0)).count() == 0


def test_hot_shards_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 32)
    monkeypatch.setattr(simhash, "FOREST_ROWS", 100)
    r = random.Random(2)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 400:
        values.add(r.choice(sorted(values)) ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)))
    values |= {r.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    nodes = spark.createDataFrame([(v, [v]) for v in signed], "node long, signature array<long>")
    masks = simhash.shard_masks
    want = slow_components({v: v & (1 << 64) - 1 for v in signed})
    for rows in (1, 10**8, 10**11):  # pigeonhole with few and with many blocks
        monkeypatch.setattr(simhash, "shard_masks", lambda settings, n, rows=rows: masks(settings, rows))
        roots = {x.node: x.root for x in graph.components(simhash.links(nodes)).collect()}
        assert {v: roots.get(v, v) for v in signed} == want


def test_similar_documents_keep_one(spark):
    plain = texts(40, 1, words=200, vocabulary=3000)
    rows = [(i, t, "x", "s") for i, t in enumerate(plain)]
    for i in range(20):  # one word in 100 changed: five-word shingles alike to about 0.9
        words = plain[i].split()
        words[50], words[150] = "changed", "again"
        rows.append((100 + i, " ".join(words), "x", "s"))
    docs = docs_of(spark, rows + [(200, plain[3], "x", "s")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(40))


def slow_near_copies(rows):
    """doc_ids that stay: brute-force Jaccard similarity of five-word shingles, and chains of links."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def edited(text, at):
    """The text with the words at some places replaced."""
    words = text.split()
    for k in at:
        words[k] = f"new{k}"
    return " ".join(words)


def test_isolated_pairs_down_to_the_limit_are_joined(spark):
    plain = texts(150, 4, words=220, vocabulary=3000)
    rows = list(enumerate(plain)) + [(1000 + i, edited(t, (20, 60, 100, 140) if i % 2 else (20, 60, 100, 140, 180))) for i, t in enumerate(plain)]
    want = slow_near_copies(rows)  # 4 words of 220: 0.83, 5: 0.79
    assert want == set(range(150)) | set(range(1000, 1150, 2))
    got = simhash.keep_one(docs_of(spark, [(i, t, "x", "s") for i, t in rows]))
    assert {r.doc_id for r in got.collect()} == want


def test_unlike_texts_with_one_repeated_passage_stay(spark):
    own, passage = texts(12, 6, words=40, vocabulary=3000), " ".join(f"again{k}" for k in range(10))
    rows = [(i, f"{t} {' '.join([passage] * 60)}") for i, t in enumerate(own)]
    base = texts(1, 7, words=300, vocabulary=3000)[0]
    rows += [(100 + i, edited(base, range(5, 300 - 12 * i, 60))) for i in range(5)]
    rows += [(200 + i, edited(base, range(10 * i, 10 * i + 60, 10))) for i in range(24)]  # a group in which some pairs are alike
    rows += [(300, None), (301, " "), (302, "one two"), (303, "ONE  Two")]
    want = slow_near_copies(rows)
    assert set(range(12)) <= want
    got = simhash.keep_one(docs_of(spark, [(i, t, "x", "s") for i, t in rows]))
    assert {r.doc_id for r in got.collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a <> 100")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {i: 0 if i <= 100 else 101 for i in range(201)}
    assert graph.components(edges.limit(0)).count() == 0


# Quality classifier


def test_quality_held_out(spark):
    found = queries.op7_quality_model(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out")
    assert found.filter((F.col("quality") == 1) & ~F.col("kept")).count() == 0
    assert found.filter((F.col("quality") == 0) & F.col("kept")).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 1.0)] * 90 + [("big", "b", 0.0)] * 60 + [("bad", "a", 0.0)] * 80 + [("new", "z", 0.0)] + [("fine", "q", 1.0)] * 200
    host_good, path_good = quality_model.posteriors(F.lit(None).cast("int"))
    counts = quality_model.site_counts(spark.createDataFrame(rows, "host string, path string, quality double"))
    sites = {(r.host, r.path): r for r in counts.select("*", host_good.alias("host_good"), path_good.alias("path_good")).collect()}
    overall = sites["big", "a"].global_good
    assert sites["bad", "a"].host_good < 0.1 < sites["big", "b"].host_good < sites["big", "a"].path_good
    assert overall > sites["new", "z"].host_good > 0.2  # one bad document says little of a host
    assert sites["fine", "q"].path_good > 0.9


def test_quality_edges(spark):
    docs = docs_of(spark, [(1, None, None, None), (2, "", "x", "s"), (3, texts(1)[0], None, "s"), (3, texts(1)[0], None, "s"), (None, "### ### $$$", "x", None)])
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, None)], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.kept for r in got if r.doc_id in (1, 2))
    assert quality_model.classify(docs.limit(0), labels).count() == 0
    assert quality_model.classify(docs, labels.limit(0)).count() == 5


# Decontamination


def test_decontamination_matches_brute_force(spark):
    items = [(0, texts(1, 7, 30)[0]), (1, texts(1, 8, 12)[0]), (2, "only four words here"), (3, None), (4, ""), (5, texts(1, 7, 30)[0])]
    noise = texts(6, 11, 500)
    rows = [
        (1, noise[0] + " " + items[0][1].upper().replace(" ", ", ") + " " + noise[1], "x", "s"),
        (2, noise[2] + " " + " ".join(items[0][1].split()[:27]), "x", "s"),  # 23 of 26 shingles
        (3, noise[2] + " " + " ".join(items[0][1].split()[:22]), "x", "s"),  # 18 of 26
        (4, items[1][1] + " " + items[2][1], "x", "s"),
        (5, None, "x", "s"),
        (6, "", "x", "s"),
        (7, "ONLY four words, here", "x", "s"),
        (7, "ONLY four words, here", "x", "s"),
    ]
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, hash int")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(docs, bench).collect())

    def shingles(t, n):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        n = n or min(5, len(w)) or 5
        return n, {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = []
    for d, t, *_ in rows:
        for i, x in items:
            length, wanted = shingles(x, None)
            n, both = len(wanted), len(wanted & shingles(t, length)[1])
            if n and both >= 0.8 * n:
                want.append((d, i, n, both))
    assert got == sorted(want) and got
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 5, 6}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_has_no_python(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    plan = decontaminate.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    sizes = [docs.count()]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, SF).cache()
        assert after.columns == docs.columns
        gone = {r.doc_id for r in held.select("doc_id").subtract(after.select("doc_id")).collect()}
        sizes.append(after.count())
        assert gone and sizes[-1] < sizes[-2], name
        if name in ("quality_classifier", "quality_rules"):  # the base rules also drop short good texts
            failed = {r.doc_id for r in quality_rules.measure_documents(docs).filter("base_failed").collect()} if name == "quality_rules" else set()
            assert sum(labels[i].quality for i in gone - failed if i in labels) == 0, name
        held = after
    last = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert last.count() == sizes[-1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in held.collect()}


def test_labels_that_teach(spark):
    import zlib

    rows = spark.range(50).select("id", training_half(F.col("id")).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.id).encode()) % 3 != 1) for r in rows)
