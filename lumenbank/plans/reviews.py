"""Queries on reviews of rows and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators import bank as B
from lumenbank.operators import mastery as M
from lumenbank.operators.ranks import placed, tiles
from lumenbank.plans.curation import NORM, TOKENS
from lumenbank.plans.gates import HALF
from lumenbank.plans.progress import STATS, rounded
from lumenbank.sources.adapters import ATTEMPTS_SQL, BANK_SQL, LETTERS, UNIVERSE_SQL, attempts, bank, table, universe

QUERIES, ORACLES = {}, {}
BANK, LOG = f"WITH {BANK_SQL}", f"WITH {ATTEMPTS_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


KEY = "CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END"


@query("agg01_group_by_pi", f"{LOG} SELECT cluster, area, pi, count(*) AS n, count(DISTINCT user_id) AS users FROM attempts GROUP BY ALL")
def group_by_pi(spark, sf):
    return attempts(spark, sf).groupBy("cluster", "area", "pi").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("join02_drift_areas", f"{LOG}, {UNIVERSE_SQL} SELECT cluster, area FROM (SELECT cluster, area FROM universe WHERE area <> 'area-2' UNION SELECT cluster, area FROM attempts)")
def drift_areas(spark, sf):
    known = universe(spark, sf).filter("area <> 'area-2'").select("cluster", "area")
    return known.union(attempts(spark, sf).select("cluster", "area")).distinct()


@query("join07_area_top_up", f"""{BANK}, own AS (SELECT cluster, area, min(pi) AS pi FROM bank GROUP BY ALL), drawn AS (SELECT b.id, b.cluster, b.area FROM bank b JOIN own USING (cluster, area, pi)), short AS (SELECT cluster, area, 6 - count(*) AS missing FROM drawn GROUP BY ALL),
    fill AS (SELECT b.id, b.cluster, b.area, row_number() OVER (PARTITION BY b.cluster, b.area ORDER BY b.id) AS place FROM bank b ANTI JOIN drawn d ON b.id = d.id) SELECT id, fill.cluster, fill.area FROM fill JOIN short USING (cluster, area) WHERE place <= missing""")
def area_top_up(spark, sf):
    rows = bank(spark, sf).select("id", "cluster", "area", "pi")
    own = rows.groupBy("cluster", "area").agg(F.min("pi").alias("pi"))
    drawn = rows.join(own, ["cluster", "area", "pi"])
    short = drawn.groupBy("cluster", "area").agg((6 - F.count("*")).alias("missing"))
    rest = rows.join(drawn.select("id"), "id", "left_anti").withColumn("place", F.row_number().over(W.partitionBy("cluster", "area").orderBy("id")))
    return rest.join(short, ["cluster", "area"]).filter("place <= missing").select("id", "cluster", "area")


@query("join11_reword_diff", f"{BANK}, r AS (SELECT id, pos + CASE WHEN id % 90 = 7 THEN 1 ELSE 0 END AS pos, CASE WHEN id % 5 = 0 THEN question || '?' ELSE question END AS question, CASE WHEN id % 70 = 3 THEN 'X' ELSE answer END AS answer FROM bank WHERE id % 40 <> 9) SELECT * FROM (SELECT b.id, CASE WHEN r.id IS NULL THEN 'dropped' WHEN r.answer <> b.answer THEN 'frozen' WHEN r.pos <> b.pos THEN 'moved' WHEN r.question <> b.question THEN 'reworded' END AS state FROM bank b LEFT JOIN r USING (id)) WHERE state IS NOT NULL")
def reword_diff(spark, sf):
    b = bank(spark, sf).select("id", "pos", "question", "answer")
    r = b.filter("id % 40 <> 9").select("id", (F.col("pos") + F.when(F.col("id") % 90 == 7, 1).otherwise(0)).alias("p"), F.when(F.col("id") % 5 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")).alias("q"), F.when(F.col("id") % 70 == 3, "X").otherwise(F.col("answer")).alias("k"))
    state = F.when(F.col("q").isNull(), "dropped").when(F.col("k") != F.col("answer"), "frozen").when(F.col("p") != F.col("pos"), "moved").when(F.col("q") != F.col("question"), "reworded")
    return b.join(r, "id", "left").select("id", state.alias("state")).filter("state IS NOT NULL")


@query("join33_regrade_split", "SELECT d.doc_id, CASE WHEN n_chars < 400 THEN 'drop' WHEN l.doc_id IS NULL THEN 'abort' WHEN quality = 0 THEN 'deny' WHEN toxic = 1 THEN 'delete' ELSE 'keep' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def regrade_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    action = F.when(F.col("n_chars") < 400, "drop").when(F.col("has").isNull(), "abort").when(F.col("quality") == 0, "deny").when(F.col("toxic") == 1, "delete").otherwise("keep")
    return rows.select("doc_id", action.alias("action"))


@query("join34_drop_homes", f"{BANK} SELECT file, pi FROM (SELECT DISTINCT file, pi FROM bank) WHERE (pi, file) NOT IN (SELECT pi, max(file) FROM bank GROUP BY pi HAVING count(DISTINCT file) > 1)")
def drop_homes(spark, sf):
    homes = bank(spark, sf).select("file", "pi").distinct()
    losing = homes.groupBy("pi").agg(F.max("file").alias("file"), F.count("*").alias("n")).filter("n > 1").select("file", "pi")
    return homes.join(losing, ["file", "pi"], "left_anti")


@query("join35_evidence_scan", "SELECT t.term, count(*) AS documents FROM (SELECT DISTINCT lower(p_brand[1:3]) AS term FROM part UNION SELECT 'tion' UNION SELECT 'heit') t JOIN documents ON contains(lower(text), t.term) GROUP BY t.term")
def evidence_scan(spark, sf):
    # The terms are a few literals, so each is a conditional count of one scan.
    terms = ["bra", "tion", "heit"]
    low = F.lower("text")
    counts = table(spark, sf, "documents").agg(*[F.count_if(F.contains(low, F.lit(t))).alias(t) for t in terms])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("documents")) for t in terms])).alias("x")).select("x.*").filter("documents > 0")


@query("agg28_stem_blind", f"""{BANK}, p AS (SELECT id, answer, list_filter(['A', 'B', 'C', 'D'], lambda x: NOT regexp_matches(lower(CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END), '[.]|!')) AS ok FROM bank)
    SELECT id, round(CASE WHEN len(ok) = 0 THEN 0.25 WHEN list_contains(ok, answer) THEN 1.0 / len(ok) ELSE 0 END, 6) AS score FROM p""")
def stem_blind(spark, sf):
    ok = F.filter(F.array(*map(F.lit, LETTERS)), lambda x: ~F.rlike(F.lower(F.col("options")[x]), F.lit("[.]|!")))
    rows = bank(spark, sf).select("id", "answer", ok.alias("ok"))
    return rounded(rows.select("id", F.when(F.size("ok") == 0, 0.25).when(F.array_contains("ok", F.col("answer")), 1.0 / F.size("ok")).otherwise(0.0).alias("score")), "score")


@query("agg30_abstaining", f"""{BANK}, l AS (SELECT id, answer, [length(a), length(b), length(c), length(d)] AS n FROM bank), f AS (SELECT id, answer, len(list_filter(n, lambda x: x = list_max(n))) = 1 AS fires, substr('ABCD', list_position(n, list_max(n))::INT, 1) AS pick FROM l)
    SELECT count(*) FILTER (WHERE fires) AS fires, count(*) FILTER (WHERE fires AND pick = answer) AS hits, count(*) AS n FROM f""")
def abstaining(spark, sf):
    rows = bank(spark, sf).select("answer", F.transform(B.values(F.col("options")), F.length).alias("n"))
    fires = F.size(F.filter("n", lambda x: x == F.array_max("n"))) == 1
    pick = F.element_at(F.array(*map(F.lit, LETTERS)), F.array_position("n", F.array_max("n")).cast("int"))
    return rows.agg(F.count_if(fires).alias("fires"), F.count_if(fires & (pick == F.col("answer"))).alias("hits"), F.count("*").alias("n"))


@query("agg11_mistake_kinds", f"{LOG} SELECT id, CASE WHEN chosen IS NULL THEN 'missed' WHEN difficulty = 'easy' AND elapsed_ms < 2000 THEN 'careless' WHEN difficulty = 'hard' AND elapsed_ms > 40000 THEN 'slow' ELSE 'missed' END AS pattern FROM attempts WHERE NOT correct")
def mistake_kinds(spark, sf):
    rows = attempts(spark, sf).filter("NOT correct").withColumns({"easy_ms": F.lit(2000.0), "hard_ms": F.lit(40000.0)})
    rows = rows.withColumn("m", F.struct("chosen", "difficulty", "elapsed_ms"))
    return rows.select("id", M.pattern(F.col("m")).alias("pattern"))


@query("flt05_tag_filter", f"{BANK} SELECT id FROM bank WHERE list_contains(string_split(file, '-'), 'ICDC') AND difficulty = 'hard'")
def tag_filter(spark, sf):
    return bank(spark, sf).filter(F.array_contains(F.split("file", "-"), "ICDC") & (F.col("difficulty") == "hard")).select("id")


@query("flt15_row_shape", f"{BANK} SELECT coalesce(CASE WHEN id % 9 > 0 THEN id::VARCHAR END, 'cand-' || pos) AS id FROM bank WHERE answer IN ('A', 'B', 'C', 'D') AND length(a) > 3")
def row_shape(spark, sf):
    rows = bank(spark, sf).filter((F.size(F.array_except(F.map_keys("options"), F.array(*map(F.lit, LETTERS)))) == 0) & F.map_contains_key("options", F.col("answer")) & (F.length(F.col("options")["A"]) > 3))
    return rows.select(F.coalesce(F.when(F.col("id") % 9 > 0, F.col("id").cast("string")), F.concat(F.lit("cand-"), "pos")).alias("id"))


@query("flt16_existence_flags", f"{BANK} SELECT cluster, level, bool_or(section = 'sets') AS has_set, bool_or(section = 'pools') AS has_pool FROM bank GROUP BY ALL")
def existence_flags(spark, sf):
    return bank(spark, sf).groupBy("cluster", "level").agg(F.bool_or(F.col("section") == "sets").alias("has_set"), F.bool_or(F.col("section") == "pools").alias("has_pool"))


@query("flt19_day_override", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE = DATE '1995-01-01' + (o_orderkey % 700)::INT THEN o_orderstatus ELSE '' END AS override FROM orders")
def day_override(spark, sf):
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("o_orderkey") % 700).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.to_date("o_orderdate") == day, F.col("o_orderstatus")).otherwise("").alias("override"))


@query("ord08_binary_collation", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS place FROM customer")
def collation(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_name", "c_custkey")).alias("place"))


@query("set04_intersect", f"{BANK} SELECT count(*) AS n FROM (SELECT id FROM bank WHERE difficulty = 'hard' INTERSECT SELECT doc_id FROM labels)")
def intersect(spark, sf):
    return bank(spark, sf).filter("difficulty = 'hard'").select("id").intersect(table(spark, sf, "labels").select("doc_id")).agg(F.count("*").alias("n"))


@query("set01_union_flatten", f"{BANK} SELECT section, count(*) AS n FROM (SELECT section FROM bank WHERE section = 'sets' UNION ALL SELECT section FROM bank WHERE section = 'pools') GROUP BY section")
def union_flatten(spark, sf):
    rows = bank(spark, sf)
    return rows.filter("section = 'sets'").unionByName(rows.filter("section = 'pools'")).groupBy("section").agg(F.count("*").alias("n"))


@query("scl01_next_day_seconds", "SELECT event_id, date_diff('second', ts, date_trunc('day', ts) + INTERVAL 1 DAY) AS seconds FROM events")
def next_day_seconds(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", (F.unix_seconds(F.date_trunc("day", ts + F.expr("interval 1 day"))) - F.unix_seconds(ts)).alias("seconds"))


@query("scl03_calendar_add", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS later FROM orders")
def calendar_add(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.date_add(F.to_date("o_orderdate"), 40), "yyyy-MM-dd").alias("later"))


@query("scl12_string_or_object", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN regexp_extract(props, '([0-9]+)', 1) ELSE 'plain-' || event_type END AS name FROM events")
def string_or_object(spark, sf):
    e = table(spark, sf, "events")
    entry = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('"plain-'), "event_type", F.lit('"')))
    v = F.parse_json(entry)
    return e.select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "string"), F.try_variant_get(v, "$", "string")).alias("name"))


STEM = "regexp_replace(CASE WHEN length(regexp_replace({0}, '(ing|ed|es|ly|s)$', '')) >= 3 THEN regexp_replace({0}, '(ing|ed|es|ly|s)$', '') ELSE {0} END, 'e$', '')"


@query("str07_stems", f"{BANK} SELECT id, array_to_string(list_sort(list_distinct(list_transform({TOKENS.format('question')}, lambda t: {STEM.format('t')}))), ' ') AS stems FROM bank")
def stems(spark, sf):
    return bank(spark, sf).select("id", F.array_join(F.array_sort(T.stems(F.col("question"))), " ").alias("stems"))


@query("str08_ngrams", f"{BANK}, w AS (SELECT id, string_split({NORM.format('question')}, ' ') AS w FROM bank) SELECT id, k AS start, array_to_string(w[k + 1:k + 4], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(0, len(w) - 3)) AS k)")
def ngrams(spark, sf):
    rows = bank(spark, sf).select("id", F.split(T.plain_norm(F.col("question")), " ").alias("w"))
    return rows.select("id", F.explode(T.word_ngrams(F.col("w"), 4)).alias("g")).select("id", "g.start", "g.gram")


@query("str12_tell_detectors", f"{BANK} SELECT id, regexp_matches(lower(explanation), '(^|[^a-z])(because|since|therefore)([^a-z]|$)') AS derives, regexp_matches(lower(explanation), 'the (correct )?answer is') AS states, regexp_matches(explanation, '!{{2,}}') AS shouts FROM bank")
def tell_detectors(spark, sf):
    e = F.col("explanation")
    return bank(spark, sf).select("id", F.rlike(F.lower(e), F.lit("(^|[^a-z])(because|since|therefore)([^a-z]|$)")).alias("derives"), F.rlike(F.lower(e), F.lit("the (correct )?answer is")).alias("states"), F.rlike(e, F.lit("!{2,}")).alias("shouts"))


@query("str14_stem_pull", f"{BANK}, t AS (SELECT id, list_distinct({TOKENS.format('question')}) AS q, list_distinct({TOKENS.format(KEY)}) AS k, list_distinct({TOKENS.format('a || chr(32) || b || chr(32) || c || chr(32) || d')}) AS o FROM bank) SELECT id, len(list_intersect(q, k)) AS key_pull, len(list_intersect(q, o)) AS all_pull FROM t")
def stem_pull(spark, sf):
    words = lambda c: F.array_distinct(T.tokens(c))
    rows = bank(spark, sf).select("id", words(F.col("question")).alias("q"), words(F.col("options")[F.col("answer")]).alias("k"), words(F.concat_ws(" ", *[F.col("options")[x] for x in LETTERS])).alias("o"))
    return rows.select("id", F.size(F.array_intersect("q", "k")).alias("key_pull"), F.size(F.array_intersect("q", "o")).alias("all_pull"))


@query("str17_word_survival", f"{BANK}, t AS (SELECT id, list_distinct({TOKENS.format('question')}) AS q, list_distinct({TOKENS.format('question || explanation')}) AS w FROM bank) SELECT id, round(coalesce(len(list_intersect(q, w)) / nullif(len(q), 0)::DOUBLE, 0), 6) AS survival FROM t")
def word_survival(spark, sf):
    rows = bank(spark, sf).select("id", F.array_distinct(T.tokens(F.col("question"))).alias("q"), F.array_distinct(T.tokens(F.concat("question", "explanation"))).alias("w"))
    return rounded(rows.select("id", T.coverage(F.col("q"), F.col("w")).alias("survival")), "survival")


@query("str21_shape_gates", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS words, len(regexp_extract_all(text, '[?]')) AS questions, regexp_matches(lower(text), '(^|[^a-z])you([^a-z]|$)') AS second_person FROM documents")
def shape_gates(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(t, F.lit(r"[^ \t\n\r]+")).alias("words"), F.regexp_count(t, F.lit("[?]")).alias("questions"), F.rlike(F.lower(t), F.lit("(^|[^a-z])you([^a-z]|$)")).alias("second_person"))


@query("str28_scenario_slice", "SELECT doc_id, regexp_extract(text, '(?s)^[^\\n]*\\n(.*?)\\n', 1) AS second_line FROM documents")
def scenario_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", r"(?s)^[^\n]*\n(.*?)\n", 1).alias("second_line"))


@query("str06_mechanical_key", f"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split({NORM.format('p_name || chr(32) || p_type')}, ' '), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END), ' ') AS key FROM part")
def mechanical_key(spark, sf):
    words = F.filter(F.split(T.plain_norm(F.concat_ws(" ", "p_name", "p_type")), " "), lambda w: ~w.isin("a", "an", "the"))
    single = F.transform(words, lambda w: F.when((F.length(w) > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.left(w, F.length(w) - 1)).otherwise(w))
    return table(spark, sf, "part").select("p_partkey", F.array_join(single, " ").alias("key"))


@query("udf02_metric_selection", f"{STATS} SELECT user_id, cluster, area, pi FROM stats WHERE evidence >= 2.5")
def metric_selection(spark, sf):
    metrics = {"evidence": F.col("evidence"), "mastery": F.col("mastery")}
    return M.pi_stats(attempts(spark, sf)).filter(metrics["evidence"] >= 2.5).select(*M.PI)


@query("udf05_expand_needs", "SELECT o_orderkey, unnest(range(1, (o_orderkey % 4 + 1)::INT)) AS slot FROM orders")
def expand_needs(spark, sf):
    rows = table(spark, sf, "orders").withColumn("need", (F.col("o_orderkey") % 4).cast("int")).filter("need > 0")
    return rows.select("o_orderkey", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("slot"))


@query("dom20_vocab_gate", "WITH homes AS (SELECT p_name, count(DISTINCT p_brand) AS homes FROM part GROUP BY p_name) SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'denied' WHEN homes > 20 THEN 'many homes' WHEN p_size > 45 THEN 'too long' ELSE 'ok' END AS verdict FROM part JOIN homes USING (p_name)")
def vocab_gate(spark, sf):
    p = table(spark, sf, "part")
    homes = p.groupBy("p_name").agg(F.count_distinct("p_brand").alias("homes"))
    verdict = F.when(F.startswith("p_name", F.lit("red")), "denied").when(F.col("homes") > 20, "many homes").when(F.col("p_size") > 45, "too long").otherwise("ok")
    return p.join(homes, "p_name").select("p_partkey", verdict.alias("verdict"))


@query("dom23_harvest_merge", f"{BANK}, c AS (SELECT pi, count(DISTINCT area) AS areas, count(DISTINCT cluster) AS cases, min(area) AS area FROM bank GROUP BY pi) SELECT pi, area, CASE WHEN areas > 1 THEN 'conflict' WHEN cases >= 3 THEN 'promoted' ELSE 'adjacent' END AS state FROM c")
def harvest_merge(spark, sf):
    c = bank(spark, sf).groupBy("pi").agg(F.count_distinct("area").alias("areas"), F.count_distinct("cluster").alias("cases"), F.min("area").alias("area"))
    return c.select("pi", "area", F.when(F.col("areas") > 1, "conflict").when(F.col("cases") >= 3, "promoted").otherwise("adjacent").alias("state"))


@query("dom30_tag_payload", f"{BANK} SELECT id, ntile(5) OVER (PARTITION BY cluster ORDER BY id) AS batch FROM bank")
def tag_payload(spark, sf):
    return placed(bank(spark, sf).select("id", "cluster"), ["cluster"], [F.col("id")]).select("id", tiles(5).alias("batch"))


@query("dom31_arm_scores", f"{BANK} SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, count(*) AS n, round(avg(length(question)), 6) AS chars, count(*) FILTER (WHERE regexp_matches(explanation, '[#$%&]{{2,}}')) AS flagged FROM bank GROUP BY 1")
def arm_scores(spark, sf):
    rows = bank(spark, sf).groupBy(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("arm"))
    return rounded(rows.agg(F.count("*").alias("n"), F.avg(F.length("question")).alias("chars"), F.count_if(F.rlike("explanation", F.lit("[#$%&]{2,}"))).alias("flagged")), "chars")


@query("src16_paged_scan", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1993-01-01'")
def paged_scan(spark, sf):
    # Both predicates reach the Parquet reader; there are no pages to walk.
    return table(spark, sf, "orders").filter((F.col("o_custkey") == 7) & (F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("src21_high_water", "SELECT c_nationkey, greatest(max(c_custkey), 40) AS high_water FROM customer GROUP BY c_nationkey")
def high_water(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.greatest(F.max("c_custkey"), F.lit(40)).alias("high_water"))


@query("src27_axis_override", "SELECT n_name, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN n_name || '-pool' END, r_name) AS pool FROM nation JOIN region ON n_regionkey = r_regionkey")
def axis_override(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.coalesce(F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit("-pool"))), "r_name").alias("pool"))


@query("src31_row_builder", "SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '(?m)^Question:[ ]*(.*)$', 1), ''), left(text, 20)) AS question, CASE WHEN length(text) > 500 THEN 'hard' WHEN length(text) > 100 THEN 'medium' ELSE 'easy' END AS difficulty FROM conversations")
def row_builder(spark, sf):
    stem = F.regexp_extract("text", r"(?m)^Question:[ ]*(.*)$", 1)
    n = F.length("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.when(stem != "", stem), F.left("text", F.lit(20))).alias("question"), F.when(n > 500, "hard").when(n > 100, "medium").otherwise("easy").alias("difficulty"))
