"""Queries that gate, pack and assemble, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators import bank as B
from lumenbank.operators import checks as K
from lumenbank.operators import packing as P
from lumenbank.operators.compose import hash_order
from lumenbank.plans.curation import LEAK, TOKENS
from lumenbank.plans.progress import rounded
from lumenbank.sources.adapters import BANK_SQL, LETTERS, bank, hashed_bank, table

QUERIES, ORACLES = {}, {}
BANK = f"WITH {BANK_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("dom08_authored_gate", f"""{BANK}, spec AS (SELECT id, substr('ABCD', (id % 4 + 1)::INT, 1) AS letter, CASE WHEN id % 7 = 0 THEN 'easy' ELSE difficulty END AS tier FROM bank WHERE id % 6 <> 5),
    j AS (SELECT h.id, h.answer, h.difficulty, letter, tier, count(*) OVER (PARTITION BY stem_hash) AS twins FROM hashed h LEFT JOIN spec USING (id))
    SELECT id, finding FROM (SELECT id, unnest([CASE WHEN letter IS NULL THEN 'hard: not assigned' END, CASE WHEN letter <> answer THEN 'hard: wrong letter' END, CASE WHEN tier <> difficulty THEN 'soft: tier' END, CASE WHEN twins > 1 THEN 'note: twin stem' END]) AS finding FROM j) WHERE finding IS NOT NULL""")
def authored_gate(spark, sf):
    rows = hashed_bank(spark, sf)
    spec = rows.filter("id % 6 <> 5").select("id", F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("id") % 4 + 1).cast("int")).alias("letter"), F.when(F.col("id") % 7 == 0, "easy").otherwise(F.col("difficulty")).alias("tier"))
    joined = rows.join(spec, "id", "left").withColumn("twins", F.count("*").over(W.partitionBy("stem_hash")))
    return K.findings(joined, {"hard: not assigned": F.col("letter").isNull(), "hard: wrong letter": F.col("letter") != F.col("answer"), "soft: tier": F.col("tier") != F.col("difficulty"), "note: twin stem": F.col("twins") > 1})


def _areas(spark, sf):
    return bank(spark, sf).groupBy("cluster", "area").agg(F.count("*").alias("n"))


@query("dom11_slice_chunks")
def slice_chunks(spark, sf):
    return P.next_fit(_areas(spark, sf), "cluster", 12)


@query("dom12_first_fit_decreasing")
def first_fit(spark, sf):
    return P.first_fit_decreasing(_areas(spark, sf), "cluster", 20)


@query("dom27_sequential_acceptance")
def sequential_acceptance(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("shelf-"), F.col("item_id") % 4).alias("shelf"), F.col("item_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return P.accept_in_order(rows, "shelf", 0.2, 8)


@query("dom19_deck_order", f"""{BANK}, t AS (SELECT id, cluster, CASE difficulty WHEN 'hard' THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY cluster, CASE difficulty WHEN 'hard' THEN 0 ELSE 1 END ORDER BY area, id) AS nth FROM bank),
    o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE tier WHEN 0 THEN nth * 3 ELSE nth + (nth - 1) // 2 END, tier, id) AS place FROM t) SELECT cluster, id, place FROM o WHERE place <= 250""")
def deck_order(spark, sf):
    tier = F.when(F.col("difficulty") == "hard", 0).otherwise(1)
    rows = bank(spark, sf).select("id", "cluster", "area", tier.alias("tier"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("cluster", "tier").orderBy("area", "id")))
    woven = F.when(F.col("tier") == 0, F.col("nth") * 3).otherwise(F.col("nth") + F.floor((F.col("nth") - 1) / 2))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(woven, "tier", "id"))).filter("place <= 250").select("cluster", "id", "place")


@query("dom22_event_pis", f"""{BANK}, p AS (SELECT cluster, area, pi, count(*) AS weight FROM bank GROUP BY ALL), core AS (SELECT *, row_number() OVER (PARTITION BY cluster, area ORDER BY sha256(pi || ':21'), pi) AS nth FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY nth, sha256(pi || ':21'), pi, area) AS place FROM core) SELECT cluster, area, pi, place FROM o WHERE place <= 7""")
def event_pis(spark, sf):
    p = bank(spark, sf).select("cluster", "area", "pi").distinct()
    p = p.withColumn("nth", F.row_number().over(W.partitionBy("cluster", "area").orderBy(hash_order(F.col("pi"), 21), "pi")))
    place = F.row_number().over(W.partitionBy("cluster").orderBy("nth", hash_order(F.col("pi"), 21), "pi", "area"))
    return p.withColumn("place", place).filter("place <= 7").select("cluster", "area", "pi", "place")


@query("dom24_leakage_audit", f"{LEAK}, i AS (SELECT unit, doc, start, start - row_number() OVER (PARTITION BY unit, doc ORDER BY start) AS island FROM m), r AS (SELECT unit, doc, count(*) + 7 AS words FROM i GROUP BY unit, doc, island) SELECT unit, count(DISTINCT doc) AS documents, max(words) AS longest, max(words) >= 15 AS failed FROM r GROUP BY unit")
def leakage_audit(spark, sf):
    published = table(spark, sf, "benchmark").select(F.col("item_id").alias("unit"), "text")
    found = B.ngram_matches(published, table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), 8, 6)
    rows = found.select("unit", "doc", "start").distinct().withColumn("island", F.col("start") - F.row_number().over(W.partitionBy("unit", "doc").orderBy("start")))
    runs = rows.groupBy("unit", "doc", "island").agg((F.count("*") + 7).alias("words"))
    return runs.groupBy("unit").agg(F.count_distinct("doc").alias("documents"), F.max("words").alias("longest"), (F.max("words") >= 15).alias("failed"))


@query("dom26_census_list", f"{BANK} SELECT id, question, answer, row_number() OVER (PARTITION BY pi ORDER BY id) AS place FROM bank WHERE pi LIKE 'src1-%'")
def census_list(spark, sf):
    rows = bank(spark, sf).filter(F.startswith("pi", F.lit("src1-")))
    return rows.select("id", "question", "answer", F.row_number().over(W.partitionBy("pi").orderBy("id")).alias("place"))


@query("dom29_prompt_context", f"{BANK} SELECT cluster, max(id // 100) + 1 AS next_batch, string_agg(DISTINCT area, ',' ORDER BY area) AS areas FROM bank GROUP BY cluster")
def prompt_context(spark, sf):
    return bank(spark, sf).groupBy("cluster").agg((F.max(F.floor(F.col("id") / 100)) + 1).alias("next_batch"), F.array_join(F.array_sort(F.collect_set("area")), ",").alias("areas"))


@query("dom18_slice_report", f"""{BANK}, s AS (SELECT cluster, level, count(*) AS n, count(DISTINCT content_hash) AS kept, count(*) FILTER (WHERE section = 'sets') AS sets FROM hashed GROUP BY ALL) SELECT cluster, level, n, kept, n - kept AS dropped, round(sets / n::DOUBLE, 6) AS set_share FROM s""")
def slice_report(spark, sf):
    s = hashed_bank(spark, sf).groupBy("cluster", "level").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("kept"), F.count_if(F.col("section") == "sets").alias("sets"))
    return rounded(s.select("cluster", "level", "n", "kept", (F.col("n") - F.col("kept")).alias("dropped"), (F.col("sets") / F.col("n")).alias("set_share")), "set_share")


@query("str19_claim_words", f"{BANK}, t AS (SELECT id, list_distinct({TOKENS.format("CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END")}) AS c, list_distinct({TOKENS.format('explanation')}) AS p FROM bank) SELECT id, coalesce(len(list_intersect(c, p)) / nullif(len(c), 0)::DOUBLE, 0) >= 0.6 AS supported FROM t")
def claim_words(spark, sf):
    """Whether the explanation speaks of the keyed option: six in ten of its words."""
    rows = bank(spark, sf).select("id", F.array_distinct(T.tokens(F.col("options")[F.col("answer")])).alias("c"), F.array_distinct(T.tokens(F.col("explanation"))).alias("p"))
    return rows.select("id", (T.coverage(F.col("c"), F.col("p")) >= 0.6).alias("supported"))


@query("str20_sections", "SELECT doc_id, place, header, length(body) AS chars FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS place, unnest(s) AS part FROM (SELECT doc_id, list_filter(string_split(text, '.' || chr(10)), lambda x: length(x) > 0) AS s FROM documents)), LATERAL (SELECT split_part(part, ' ', 1) AS header, CASE WHEN contains(part, ' ') THEN substr(part, strpos(part, ' ') + 1) ELSE '' END AS body)")
def sections(spark, sf):
    parts = F.filter(F.split("text", r"\.\n"), lambda x: F.length(x) > 0)
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("place", "part"))
    space = F.instr("part", " ")
    return rows.select("doc_id", (F.col("place") + 1).alias("place"), F.when(space > 0, F.substr("part", F.lit(1), space - 1)).otherwise(F.col("part")).alias("header"), F.when(space > 0, F.length("part") - space).otherwise(0).alias("chars"))


@query("str24_exhibit_place", "SELECT doc_id, CASE WHEN strpos(text, '|') = 0 THEN 'none' WHEN strpos(text, '|') * 2 < length(text) THEN 'first half' ELSE 'second half' END AS exhibit FROM documents")
def exhibit_place(spark, sf):
    at = F.instr("text", "|")
    return table(spark, sf, "documents").select("doc_id", F.when(at == 0, "none").when(at * 2 < F.length("text"), "first half").otherwise("second half").alias("exhibit"))


@query("str25_report_check", "SELECT conv_id, count(DISTINCT role) <= 2 AS two_parties, count(*) >= 2 AS enough, bool_and(length(text) > 0) AS filled FROM conversations GROUP BY conv_id")
def report_check(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.count_distinct("role") <= 2).alias("two_parties"), (F.count("*") >= 2).alias("enough"), F.bool_and(F.length("text") > 0).alias("filled"))


@query("udf01_pattern_registry", f"{BANK} SELECT id, unnest(list_filter([CASE WHEN regexp_matches(question, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(question, '[|]') THEN 'pipe' END, CASE WHEN regexp_matches(question, '!') THEN 'bang' END], lambda x: x IS NOT NULL)) AS pattern FROM bank")
def pattern_registry(spark, sf):
    patterns = {"digit": "[0-9]", "pipe": "[|]", "bang": "!"}
    return K.findings(bank(spark, sf), {k: F.rlike("question", F.lit(v)) for k, v in patterns.items()}).select("id", F.col("finding").alias("pattern"))
