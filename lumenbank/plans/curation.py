"""Queries over the question bank and its snapshots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators import bank as B
from lumenbank.operators.ranks import numbered, placed, tiles
from lumenbank.plans.progress import rounded
from lumenbank.sources.adapters import BANK_SQL, LETTERS, LEVELS, TIERS, bank, hashed_bank, table

QUERIES, ORACLES = {}, {}
BANK = f"WITH {BANK_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("str03_hashes", f"{BANK} SELECT id, content_hash, stem_hash FROM hashed")
def hashes(spark, sf):
    return hashed_bank(spark, sf).select("id", "content_hash", "stem_hash")


@query("src02_scan_candidates", f"{BANK} SELECT id, file FROM (SELECT *, row_number() OVER (PARTITION BY stem_hash ORDER BY section DESC, pos) AS nth FROM hashed WHERE cluster = 'en' AND level = 'ICDC') WHERE nth = 1")
def scan_candidates(spark, sf):
    rows = hashed_bank(spark, sf).filter("cluster = 'en' AND level = 'ICDC'")
    return B.keep_first(rows, ["stem_hash"], [F.desc("section"), F.col("pos")]).select("id", "file")


@query("src04_lookup_by_ids", f"{BANK} SELECT id, place, area FROM bank JOIN (VALUES (0, 17), (1, 3), (3, 42), (4, 11)) v(place, id) USING (id)")
def lookup(spark, sf):
    return B.lookup_in_order(bank(spark, sf), [17, 3, 999_999_999, 42, 11]).select("id", "place", "area")


@query("flt04_text_search", f"{BANK} SELECT id FROM bank WHERE difficulty = 'medium' AND (contains(lower(question), 'tion') OR contains(lower(pi), 'tion') OR contains(lower(a), 'tion') OR contains(lower(b), 'tion') OR contains(lower(c), 'tion') OR contains(lower(d), 'tion'))")
def text_search(spark, sf):
    return B.search(bank(spark, sf), "TION", difficulty="medium").select("id")


@query("agg19_manifest", f"{BANK} SELECT file, cluster, level, section, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE difficulty = '{t}') AS {t}" for t in TIERS) + ", " + ", ".join(f"count(*) FILTER (WHERE answer = '{x}') AS {x}" for x in LETTERS) + " FROM bank GROUP BY file, cluster, level, section")
def manifest(spark, sf):
    return B.manifest(bank(spark, sf))


@query("agg15_blueprint_counts", f"""{BANK}, per AS (SELECT cluster, level, area, count(*) FILTER (WHERE section = 'sets') AS s, count(*) FILTER (WHERE section = 'pools') AS p FROM bank GROUP BY ALL),
    chosen AS (SELECT *, CASE WHEN sum(s) OVER (PARTITION BY cluster, level) > 0 THEN s ELSE p END AS n FROM per) SELECT cluster, area, sum(n)::BIGINT AS n FROM chosen WHERE n > 0 GROUP BY ALL""")
def blueprint_counts(spark, sf):
    return B.area_counts(bank(spark, sf))


@query("agg16_metadata_counters", f"{BANK} SELECT cluster, count(*) FILTER (WHERE section = 'pools') AS pool_depth, count(*) FILTER (WHERE difficulty = 'hard') AS hard_depth, count(*) AS questions FROM bank GROUP BY cluster")
def metadata_counters(spark, sf):
    return bank(spark, sf).groupBy("cluster").agg(F.count_if(F.col("section") == "pools").alias("pool_depth"), F.count_if(F.col("difficulty") == "hard").alias("hard_depth"), F.count("*").alias("questions"))


@query("agg17_inventory", f"{BANK} SELECT cluster, level, area, string_agg(DISTINCT pi, ',' ORDER BY pi) AS pis FROM bank GROUP BY cluster, level, area")
def inventory(spark, sf):
    return B.inventory(bank(spark, sf)).withColumn("pis", F.array_join("pis", ","))


@query("agg18_universe_size", f"{BANK} SELECT cluster, count(DISTINCT (area, pi)) AS pis, count(DISTINCT (area, pi)) // 50 * 50 AS label FROM bank GROUP BY cluster")
def universe_size(spark, sf):
    n = F.count_distinct(F.struct("area", "pi"))
    return bank(spark, sf).groupBy("cluster").agg(n.alias("pis"), (F.floor(n / 50) * 50).alias("label"))


@query("agg20_spread_check", f"""{BANK}, t AS (SELECT section, file, count(*) FILTER (WHERE difficulty = 'easy') AS e, count(*) FILTER (WHERE difficulty = 'medium') AS m, count(*) FILTER (WHERE difficulty = 'hard') AS h FROM bank GROUP BY ALL)
    SELECT section, count(*) AS files, count(DISTINCT (e, m, h)) AS triples, count(DISTINCT (e, m, h)) = 1 OR count(DISTINCT (e, m, h)) < count(*) / 2 AS failed FROM t GROUP BY section""")
def spread_check(spark, sf):
    triples = F.count_distinct(F.struct(*TIERS))
    return B.manifest(bank(spark, sf)).groupBy("section").agg(F.count("*").alias("files"), triples.alias("triples"), ((triples == 1) | (triples < F.count("*") / 2)).alias("failed"))


@query("agg21_rubric_parity", f"""{BANK}, p AS (SELECT section, """ + ", ".join(f"100.0 * count(*) FILTER (WHERE difficulty = '{t}') / count(*) AS {t}" for t in TIERS) + """ FROM bank GROUP BY GROUPING SETS ((section), ()))
    SELECT coalesce(section, 'bank') AS section, round(easy, 6) AS easy, round(medium, 6) AS medium, round(hard, 6) AS hard FROM p""")
def rubric_parity(spark, sf):
    shares = [(100.0 * F.count_if(F.col("difficulty") == t) / F.count("*")).alias(t) for t in TIERS]
    return rounded(bank(spark, sf).rollup("section").agg(*shares).na.fill("bank", ["section"]), *TIERS)


@query("agg22_duplicate_groups", f"{BANK} SELECT cluster, level, content_hash, count(*) AS n, min(id) AS first_id FROM hashed GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return B.duplicate_groups(hashed_bank(spark, sf), ["cluster", "level", "content_hash"])


@query("win06_keep_first", f"{BANK} SELECT id AS removed_id, kept_id FROM (SELECT id, row_number() OVER w AS nth, first(id) OVER w AS kept_id FROM hashed WINDOW w AS (PARTITION BY stem_hash ORDER BY file, pos)) WHERE nth > 1")
def keep_first(spark, sf):
    return B.collapse(hashed_bank(spark, sf), ["stem_hash"], ["file", "pos"])[1]


@query("dom10_collapse_survivors", f"{BANK} SELECT cluster, count(*) AS n FROM (SELECT cluster, row_number() OVER (PARTITION BY stem_hash ORDER BY file, pos) AS nth FROM hashed) WHERE nth = 1 GROUP BY cluster")
def survivors(spark, sf):
    return B.collapse(hashed_bank(spark, sf), ["stem_hash"], ["file", "pos"])[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query("join18_stem_twins", f"""{BANK} SELECT s.id, min(CASE WHEN p.level = s.level THEN 'drop' ELSE 'flag' END) AS action FROM hashed s JOIN hashed p ON s.stem_hash = p.stem_hash AND s.section = 'sets' AND p.section = 'pools' GROUP BY s.id""")
def stem_twins(spark, sf):
    rows = hashed_bank(spark, sf).select("id", "stem_hash", "level", "section")
    pools = rows.filter("section = 'pools'").select("stem_hash", F.col("level").alias("at")).distinct()
    return rows.filter("section = 'sets'").join(pools, "stem_hash").groupBy("id").agg(F.min(F.when(F.col("at") == F.col("level"), "drop").otherwise("flag")).alias("action"))


@query("join19_pool_set_collisions", f"{BANK} SELECT content_hash FROM hashed WHERE section = 'sets' INTERSECT SELECT content_hash FROM hashed WHERE section = 'pools'")
def collisions(spark, sf):
    rows = hashed_bank(spark, sf)
    return rows.filter("section = 'sets'").select("content_hash").intersect(rows.filter("section = 'pools'").select("content_hash"))


@query("agg23_facets", f"""{BANK}, cube AS (SELECT cluster, difficulty, section, count(*) AS n FROM bank GROUP BY ALL)
    SELECT 'cluster' AS facet, cluster AS value, coalesce(sum(n) FILTER (WHERE difficulty = 'hard' AND section = 'sets'), 0)::BIGINT AS n FROM cube GROUP BY cluster
    UNION ALL SELECT 'difficulty', difficulty, coalesce(sum(n) FILTER (WHERE cluster = 'en' AND section = 'sets'), 0)::BIGINT FROM cube GROUP BY difficulty
    UNION ALL SELECT 'section', section, coalesce(sum(n) FILTER (WHERE cluster = 'en' AND difficulty = 'hard'), 0)::BIGINT FROM cube GROUP BY section""")
def facets(spark, sf):
    return B.facet_counts(bank(spark, sf), {"cluster": "en", "difficulty": "hard", "section": "sets"})


LENS_SQL = """, told AS (SELECT *, greatest(length(a), length(b), length(c), length(d)) AS top, least(length(a), length(b), length(c), length(d)) AS low,
        CASE answer WHEN 'A' THEN length(a) WHEN 'B' THEN length(b) WHEN 'C' THEN length(c) ELSE length(d) END AS key_len,
        greatest(CASE WHEN answer <> 'A' THEN length(a) END, CASE WHEN answer <> 'B' THEN length(b) END, CASE WHEN answer <> 'C' THEN length(c) END, CASE WHEN answer <> 'D' THEN length(d) END) AS other
    FROM bank), tells AS (SELECT *, (length(a) > key_len)::INT + (length(b) > key_len)::INT + (length(c) > key_len)::INT + (length(d) > key_len)::INT + 1 AS key_rank,
        (length(a) = top)::INT + (length(b) = top)::INT + (length(c) = top)::INT + (length(d) = top)::INT AS ties, key_len - other AS margin, key_len = low AS shortest FROM told)"""
STATS_SQL = """count(*) AS n, count(*) FILTER (WHERE key_rank = 1) AS among_longest, count(*) FILTER (WHERE margin > 0) AS strictly_longest, count(*) FILTER (WHERE shortest) AS shortest,
    count(*) FILTER (WHERE margin >= 5) AS margin_5, round(avg(CASE WHEN key_rank = 1 THEN 1.0 / ties ELSE 0 END), 6) AS pick_longest, round(avg(key_len), 6) AS mean_key"""


@query("win09_option_rank", f"{BANK}{LENS_SQL} SELECT id, key_len, key_rank, ties, margin, shortest FROM tells")
def option_rank(spark, sf):
    return B.with_length_tells(bank(spark, sf)).select("id", "key_len", "key_rank", "ties", "margin", "shortest")


@query("agg24_length_tells", f"{BANK}{LENS_SQL} SELECT section, {STATS_SQL} FROM tells GROUP BY section")
def length_tells(spark, sf):
    return rounded(B.with_length_tells(bank(spark, sf)).groupBy("section").agg(*B.length_stats()), "pick_longest", "mean_key")


@query("agg25_rollup", f"{BANK}{LENS_SQL} SELECT section, cluster, level, grouping(section, cluster, level) AS grouping, {STATS_SQL} FROM tells GROUP BY GROUPING SETS ((), (section), (cluster, level), (section, level))")
def rollup(spark, sf):
    return rounded(B.length_rollup(bank(spark, sf)), "pick_longest", "mean_key")


@query("agg45_slice_strategy", f"{BANK}{LENS_SQL} SELECT cluster, level, round(avg(CASE WHEN key_rank = 1 THEN 1.0 / ties ELSE 0 END), 6) AS pick_longest FROM tells GROUP BY ALL")
def slice_strategy(spark, sf):
    return rounded(B.with_length_tells(bank(spark, sf)).groupBy("cluster", "level").agg(B.length_stats()[5]), "pick_longest")


@query("win13_over_budget", f"""{BANK}{LENS_SQL}, b AS (SELECT id, margin, count(*) FILTER (WHERE margin > 0) OVER (PARTITION BY file) - floor(0.25 * count(*) OVER (PARTITION BY file)) AS budget, row_number() OVER (PARTITION BY file ORDER BY margin DESC, id) AS place FROM tells)
    SELECT id, margin FROM b WHERE margin > 0 AND (place <= budget OR margin >= 6)""")
def over_budget(spark, sf):
    return B.over_budget(bank(spark, sf), 0.25, 6).select("id", "margin")


PATTERNS = {"th": "th", "hyphen": "[.]", "ending": "ing"}


@query("agg26_wording_lift", f"{BANK}, r AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, regexp_matches(lower(a), '{p}')::INT + regexp_matches(lower(b), '{p}')::INT + regexp_matches(lower(c), '{p}')::INT + regexp_matches(lower(d), '{p}')::INT AS marks, regexp_matches(lower(CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END), '{p}')::INT AS key FROM bank" for n, p in PATTERNS.items()
) + ") SELECT pattern, count(*) AS tagged, sum(key)::BIGINT AS key_tagged, round(avg(marks / 4.0), 6) AS chance, round(avg(key) / avg(marks / 4.0), 6) AS lift FROM r WHERE marks > 0 GROUP BY pattern")
def wording_lift(spark, sf):
    return rounded(B.pattern_lift(bank(spark, sf), PATTERNS), "chance", "lift")


TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "], w))"


@query("str07_tokens", f"{BANK} SELECT id, array_to_string({TOKENS.format('question')}, ' ') AS tokens FROM bank")
def tokens(spark, sf):
    return bank(spark, sf).select("id", F.array_join(T.tokens(F.col("question")), " ").alias("tokens"))


@query("agg29_idf", f"{BANK}, t AS (SELECT unnest(list_distinct({TOKENS.format(chr(39).join(['concat_ws(', ' ', ', question, a, b, c, d)']))})) AS token FROM bank), n AS (SELECT count(*) AS n FROM bank) SELECT token, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)::DOUBLE) + 1, 6) AS idf FROM t, n GROUP BY token")
def idf(spark, sf):
    return rounded(B.document_frequency(bank(spark, sf)), "idf")


@query("str01_dedup_norm", f"{BANK} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(question, '‘’“”–— ', '''''\"\"-- ')), '[-/]', ' ', 'g'), '[.,;:!?\"''()]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS norm FROM bank")
def dedup_norm(spark, sf):
    return bank(spark, sf).select("id", T.dedup_norm(F.col("question")).alias("norm"))


@query("str02_plain_norm", f"{BANK} SELECT id, trim(regexp_replace(regexp_replace(lower(explanation), '-([0-9])', 'neg \\1', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ') AS norm FROM bank")
def plain_norm(spark, sf):
    return bank(spark, sf).select("id", T.plain_norm(F.col("explanation")).alias("norm"))


@query("str04_slug", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


@query("str09_jaccard", f"{BANK}, t AS (SELECT id, list_distinct({TOKENS.format('question')}) AS q, list_distinct({TOKENS.format('explanation')}) AS e FROM bank) SELECT id, round(coalesce(len(list_intersect(q, e)) / nullif(len(list_distinct(list_concat(q, e))), 0)::DOUBLE, 0), 6) AS jaccard, round(coalesce(len(list_intersect(q, e)) / nullif(len(q), 0)::DOUBLE, 0), 6) AS coverage FROM t")
def jaccard(spark, sf):
    rows = bank(spark, sf).select("id", F.array_distinct(T.tokens(F.col("question"))).alias("q"), F.array_distinct(T.tokens(F.col("explanation"))).alias("e"))
    return rounded(rows.select("id", T.jaccard(F.col("q"), F.col("e")).alias("jaccard"), T.coverage(F.col("q"), F.col("e")).alias("coverage")), "jaccard", "coverage")


@query("str11_figures", "SELECT doc_id AS id, len(regexp_extract_all(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1)) AS n FROM documents")
def figures(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.size(T.figures(F.col("text"))).alias("n"))


@query("str18_gist", f"{BANK} SELECT id, array_to_string(list_slice(string_split(q, ' '), 1, 5), ' ') || CASE WHEN len(string_split(q, ' ')) > 5 THEN '…' ELSE '' END AS gist FROM (SELECT id, trim(regexp_replace(question, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS q FROM bank)")
def gist(spark, sf):
    return bank(spark, sf).select("id", T.gist(F.col("question"), 5).alias("gist"))


@query("agg32_mode_first_seen", f"{BANK}, n AS (SELECT area, difficulty, count(*) AS n, min(pos) AS seen FROM bank GROUP BY ALL) SELECT area, difficulty, n FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, seen) AS nth FROM n) WHERE nth = 1")
def mode_first_seen(spark, sf):
    return B.most_common(bank(spark, sf), "area", "difficulty", "pos")


DEFICIT_SQL = f"""{BANK}, have AS (SELECT cluster, area, pi, level, """ + ", ".join(f"count(*) FILTER (WHERE difficulty = '{t}') AS have_{t}" for t in TIERS) + """ FROM bank GROUP BY ALL
    ), full_ AS (SELECT p.cluster, p.area, p.pi, l.level, """ + ", ".join(f"coalesce(have_{t}, 0) AS have_{t}, greatest(0, 3 - coalesce(have_{t}, 0)) AS need_{t}" for t in TIERS) + """
        FROM (SELECT DISTINCT cluster, area, pi FROM bank) p CROSS JOIN (VALUES ('District'), ('Association'), ('ICDC')) l(level) LEFT JOIN have USING (cluster, area, pi, level))"""


@query("agg33_pi_deficit", f"{DEFICIT_SQL} SELECT *, need_easy + need_medium + need_hard AS need_total FROM full_")
def pi_deficit(spark, sf):
    return B.deficit(bank(spark, sf), 8)


@query("agg34_area_deficit", f"{DEFICIT_SQL} SELECT cluster, area, sum(need_easy + need_medium + need_hard)::BIGINT AS need, count(DISTINCT pi) FILTER (WHERE need_easy + need_medium + need_hard > 0) AS pis_owed FROM full_ GROUP BY ALL")
def area_deficit(spark, sf):
    return B.deficit(bank(spark, sf), 8).groupBy("cluster", "area").agg(F.sum("need_total").alias("need"), F.count_distinct(F.when(F.col("need_total") > 0, F.col("pi"))).alias("pis_owed"))


def _returns(spark, sf):
    d = table(spark, sf, "labels")
    one = lambda r, c: d.select(F.col("doc_id").alias("cand_id"), F.lit(r).alias("rater"), F.when(F.col("doc_id") % 17 == 0, "DEFECTIVE").when(F.col(c) == 1, "HARD").otherwise("MEDIUM").alias("verdict"))
    return one("a", "quality").unionByName(one("b", "toxic"))


RETURNS = "WITH returns AS (" + " UNION ALL ".join(f"SELECT doc_id AS cand_id, '{r}' AS rater, CASE WHEN doc_id % 17 = 0 THEN 'DEFECTIVE' WHEN {c} = 1 THEN 'HARD' ELSE 'MEDIUM' END AS verdict FROM labels" for r, c in (("a", "quality"), ("b", "toxic"))) + "), outcomes AS (SELECT cand_id, count(*) AS raters, CASE WHEN count(*) FILTER (WHERE verdict = 'DEFECTIVE') > 0 THEN 'defective' WHEN count(DISTINCT verdict) > 1 THEN 'split' ELSE 'agreed_' || lower(min(verdict)) END AS outcome FROM returns GROUP BY cand_id)"


@query("join13_reconcile_raters", f"{RETURNS} SELECT * FROM outcomes")
def reconcile(spark, sf):
    return B.reconcile(_returns(spark, sf))


@query("agg35_rater_tallies", f"{RETURNS} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def rater_tallies(spark, sf):
    return B.reconcile(_returns(spark, sf)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("set05_missing_foreign_duplicate", "WITH want AS (SELECT DISTINCT doc_id FROM documents), got AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id * 3 FROM labels WHERE doc_id % 5 = 0) GROUP BY doc_id) SELECT doc_id, kind FROM (SELECT coalesce(w.doc_id, g.doc_id) AS doc_id, CASE WHEN g.doc_id IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'foreign' WHEN n > 1 THEN 'duplicate' END AS kind FROM want w FULL JOIN got g ON w.doc_id = g.doc_id) WHERE kind IS NOT NULL")
def triad(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    returned = labels.unionByName(labels.filter("doc_id % 5 = 0").select((F.col("doc_id") * 3).alias("doc_id")))
    return B.missing_foreign_duplicate(table(spark, sf, "documents").select("doc_id"), returned, "doc_id")


def _later_orders(spark, sf):
    o = table(spark, sf, "orders")
    changed = o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")), "o_custkey": F.when(F.col("o_orderkey") % 101 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))}).filter("o_orderkey % 7 <> 0")
    return changed.unionByName(o.filter("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))


LATER = "WITH later AS (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 50 = 1)"


@query("join10_snapshot_diff", f"{LATER} SELECT o_orderkey, change FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'vanished' WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'frozen' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'changed' END AS change FROM orders a FULL JOIN later b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL")
def snapshot_diff(spark, sf):
    return B.snapshot_diff(table(spark, sf, "orders"), _later_orders(spark, sf), "o_orderkey", ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("join08_new_rows", f"{LATER} SELECT o_orderkey FROM later ANTI JOIN orders USING (o_orderkey)")
def new_rows(spark, sf):
    return _later_orders(spark, sf).join(table(spark, sf, "orders"), "o_orderkey", "left_anti").select("o_orderkey")


@query("join09_changed_rows", f"{LATER} SELECT b.o_orderkey FROM later b JOIN orders a USING (o_orderkey) WHERE a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def changed_rows(spark, sf):
    a, b = table(spark, sf, "orders").alias("a"), _later_orders(spark, sf).alias("b")
    pick = lambda x: F.struct(f"{x}.o_custkey", f"{x}.o_orderstatus")
    return a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey")).filter(~pick("a").eqNullSafe(pick("b"))).select("b.o_orderkey")


@query("scl06_largest_remainder", """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), e AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY c_nationkey)::DOUBLE AS exact FROM c),
    f AS (SELECT *, floor(exact)::BIGINT AS whole, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(exact - floor(exact), 9) DESC, c_mktsegment) AS place FROM e)
    SELECT c_nationkey, c_mktsegment, n, whole + CASE WHEN place <= 100 - sum(whole) OVER (PARTITION BY c_nationkey) THEN 1 ELSE 0 END AS quota FROM f""")
def largest_remainder(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).withColumn("hundred", F.lit(100))
    return B.largest_remainder(counts, ["c_nationkey"], "n", "hundred", "c_mktsegment").drop("hundred")


NORM = "trim(regexp_replace(regexp_replace(lower({}), '-([0-9])', 'neg \\1', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ')"
GRAMS = "SELECT DISTINCT {key}, array_to_string(w[k + 1:k + 8], ' ') AS gram, k AS start FROM (SELECT {key}, string_split(" + NORM.format("text") + ", ' ') AS w FROM {src}), LATERAL (SELECT unnest(range(0, len(w) - 7)) AS k)"
LEAK = "WITH published AS (SELECT item_id AS unit, text FROM benchmark), corpus AS (SELECT doc_id AS doc, text FROM documents), pg AS (" + GRAMS.format(key="unit", src="published") + "), cg AS (SELECT DISTINCT doc, gram FROM (" + GRAMS.format(key="doc", src="corpus") + ")), ok AS (SELECT gram FROM cg GROUP BY gram HAVING count(*) < 6), m AS (SELECT unit, start, gram, doc FROM pg JOIN cg USING (gram) SEMI JOIN ok USING (gram))"


def _leaks(spark, sf):
    return B.ngram_matches(table(spark, sf, "benchmark").select(F.col("item_id").alias("unit"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), 8, 6)


@query("join22_ngram_leakage", f"{LEAK} SELECT unit, start, gram, doc FROM m")
def leakage(spark, sf):
    return _leaks(spark, sf).select("unit", "start", "gram", "doc")


@query("win16_longest_runs", f"{LEAK}, i AS (SELECT unit, doc, start, start - row_number() OVER (PARTITION BY unit, doc ORDER BY start) AS island FROM m), r AS (SELECT unit, doc, count(*) + 7 AS words, min(start) AS start FROM i GROUP BY unit, doc, island) SELECT unit, doc, start, words FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY words DESC, start, doc) AS nth FROM r) WHERE nth = 1")
def longest_runs(spark, sf):
    return B.longest_runs(_leaks(spark, sf), 8)


@query("agg44_dimension_lists", f"{BANK} SELECT cluster, string_agg(level, ',' ORDER BY place) AS levels FROM (SELECT DISTINCT cluster, level, CASE level WHEN 'District' THEN 0 WHEN 'Association' THEN 1 ELSE 2 END AS place FROM bank) GROUP BY cluster")
def dimension_lists(spark, sf):
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    rows = bank(spark, sf).select("cluster", F.struct(place.alias("place"), "level").alias("l")).distinct()
    return rows.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["level"]), ",").alias("levels"))


@query("win17_even_batches", f"{BANK} SELECT id, ntile(7) OVER (PARTITION BY cluster ORDER BY file, pos) AS batch FROM bank")
def even_batches(spark, sf):
    return placed(bank(spark, sf).select("id", "cluster", "file", "pos"), ["cluster"], [F.col("file"), F.col("pos")]).select("id", tiles(7).alias("batch"))


@query("win07_top_n_per_group", f"{BANK} SELECT pi, id, place FROM (SELECT pi, id, row_number() OVER (PARTITION BY pi ORDER BY id DESC) AS place FROM bank) WHERE place <= 3")
def top_n(spark, sf):
    return bank(spark, sf).select("pi", "id", F.row_number().over(W.partitionBy("pi").orderBy(F.desc("id"))).alias("place")).filter("place <= 3")


@query("win14_stratified_interleave", f"{BANK} SELECT id, row_number() OVER (PARTITION BY file ORDER BY round((nth - 0.5) / size, 9), difficulty, id) AS place FROM (SELECT id, file, difficulty, row_number() OVER (PARTITION BY file, difficulty ORDER BY pos) AS nth, count(*) OVER (PARTITION BY file, difficulty) AS size FROM bank)")
def interleave(spark, sf):
    rows = placed(bank(spark, sf).select("id", "file", "difficulty", "pos"), ["file", "difficulty"], [F.col("pos")], "nth")
    rows = rows.withColumn("at", F.round((F.col("nth") + 0.5) / F.col("size"), 9))
    return numbered(rows, ["file"], [F.col("at"), F.col("difficulty"), F.col("id")]).select("id", "place")


@query("win15_round_robin", f"{BANK} SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY nth, area) AS place FROM (SELECT id, cluster, area, row_number() OVER (PARTITION BY cluster, area ORDER BY pos) AS nth FROM bank)")
def round_robin(spark, sf):
    rows = numbered(bank(spark, sf).select("id", "cluster", "area", "pos"), ["cluster", "area"], [F.col("pos")], "nth")
    return numbered(rows, ["cluster"], [F.col("nth"), F.col("area")]).select("id", "place")


@query("ord01_coverage_summary", f"{BANK}, n AS (SELECT cluster, area, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, area) AS place FROM bank GROUP BY cluster, area) SELECT cluster, string_agg(area, ', ' ORDER BY place) FILTER (WHERE place <= 3) AS top, string_agg(area, ', ' ORDER BY place) FILTER (WHERE place IN (4, 5)) AS next, greatest(count(*) - 5, 0) AS rest FROM n GROUP BY cluster")
def coverage_summary(spark, sf):
    counts = bank(spark, sf).groupBy("cluster", "area").agg(F.count("*").alias("n"))
    areas = counts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "area"))), lambda x: x["area"]).alias("a"))
    part = lambda i, n: F.when(F.size("a") >= i, F.array_join(F.slice("a", i, n), ", "))
    return areas.select("cluster", part(1, 3).alias("top"), part(4, 2).alias("next"), F.greatest(F.size("a") - 5, F.lit(0)).alias("rest"))


@query("agg38_figure_rate", f"{BANK} SELECT cluster, round(avg(regexp_matches(question || explanation, '[0-9]')::INT), 6) AS rate FROM bank GROUP BY cluster")
def figure_rate(spark, sf):
    return rounded(bank(spark, sf).groupBy("cluster").agg(F.avg(F.rlike(F.concat("question", "explanation"), F.lit("[0-9]")).cast("int")).alias("rate")), "rate")


@query("agg31_order_statistic", "SELECT lang, list_sort(list(n_chars))[least(count(*) - 1, (0.9 * count(*))::DOUBLE::INT - CASE WHEN (0.9 * count(*))::DOUBLE::INT > 0.9 * count(*) THEN 1 ELSE 0 END) + 1] AS p90, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY lang")
def order_statistic(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "n_chars")
    rows = placed(rows, ["lang"], [F.col("n_chars")], "at", "n")
    pick = lambda i: F.max(F.when(F.col("at") == i, F.col("n_chars")))
    return rows.groupBy("lang").agg(pick(F.least(F.col("n") - 1, F.floor(F.lit(0.9) * F.col("n")))).alias("p90"), pick(F.floor(F.col("n") / 2)).alias("upper_median"))
