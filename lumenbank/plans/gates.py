"""Queries on gates, sinks, label joins and text checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators import bank as B
from lumenbank.operators import checks as K
from lumenbank.operators.ranks import numbered
from lumenbank.plans.curation import NORM, TOKENS
from lumenbank.plans.progress import rounded
from lumenbank.sources import sinks as S
from lumenbank.sources.adapters import ATTEMPTS_SQL, BANK_SQL, LETTERS, TIERS, attempts, bank, table

QUERIES, ORACLES = {}, {}
BANK, LOG = f"WITH {BANK_SQL}", f"WITH {ATTEMPTS_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


ANY = lambda test: " OR ".join(test.format(x) for x in "abcd")


@query("udf03_gate_findings", f"""{BANK}, g AS (SELECT id, [CASE WHEN {ANY("length({}) = 0")} THEN 'empty option' END, CASE WHEN len(list_distinct([a, b, c, d])) < 4 THEN 'equal options' END,
    CASE WHEN {ANY(f"regexp_matches(lower({{}}), '{K.ABSOLUTE}')")} THEN 'absolute' END, CASE WHEN {ANY(f"regexp_matches(lower({{}}), '{K.COMBINED}')")} THEN 'combined' END,
    CASE WHEN regexp_matches(a, '[0-9]')::INT + regexp_matches(b, '[0-9]')::INT + regexp_matches(c, '[0-9]')::INT + regexp_matches(d, '[0-9]')::INT >= 3 THEN 'numeric' END] AS f FROM bank)
    SELECT id, finding FROM (SELECT id, unnest(f) AS finding FROM g) WHERE finding IS NOT NULL""")
def gate_findings(spark, sf):
    return K.findings(bank(spark, sf), K.option_gates())


@query("dom09_shared_options", f"{BANK}, o AS (" + " UNION ALL ".join(f"SELECT id, {NORM.format(x)} AS option FROM bank" for x in "abcd") + ") SELECT option, count(DISTINCT id) AS questions, min(id) AS first_id FROM o WHERE length(option) >= 12 GROUP BY option HAVING count(DISTINCT id) > 1")
def shared_options(spark, sf):
    return K.shared_options(bank(spark, sf), 12)


@query("flt12_numeric_scope", f"{BANK} SELECT id FROM bank WHERE regexp_matches(question, '[0-9]') AND regexp_matches(explanation, '[0-9]')")
def numeric_scope(spark, sf):
    return bank(spark, sf).filter(F.rlike("question", F.lit("[0-9]")) & F.rlike("explanation", F.lit("[0-9]"))).select("id")


@query("flt10_projection", f"{BANK} SELECT id, question, area FROM bank")
def projection(spark, sf):
    rows = bank(spark, sf)
    return rows.select(*[c for c in ("id", "question", "missing_column", "area") if c in rows.columns])


@query("flt11_leak_tokens", f"{BANK} SELECT id FROM bank WHERE regexp_matches(question || ' ' || explanation, '(?i)(token|answer|password)')")
def leak_tokens(spark, sf):
    return bank(spark, sf).filter(F.rlike(F.concat_ws(" ", "question", "explanation"), F.lit("(?i)(token|answer|password)"))).select("id")


@query("flt08_census", f"{BANK} SELECT pi, count(*) AS n, count(DISTINCT file) AS files, count(*) = 8 AS as_expected FROM bank WHERE pi IN ('src0-0', 'src1-1', 'src2-2') GROUP BY pi")
def census(spark, sf):
    rows = bank(spark, sf).filter(F.trim("pi").isin("src0-0", "src1-1", "src2-2"))
    return rows.groupBy("pi").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), (F.count("*") == 8).alias("as_expected"))


@query("flt01_grade", "SELECT event_id, coalesce(CASE WHEN event_id % 37 <> 0 THEN substr('ABCD', (event_id % 4 + 1)::INT, 1) END = substr('ABCD', (event_id % 3 + 1)::INT, 1), FALSE) AS correct FROM events")
def grade(spark, sf):
    key = F.substring(F.lit("ABCD"), (F.col("id") % 3 + 1).cast("int"), F.lit(1))
    return attempts(spark, sf).select(F.col("id").alias("event_id"), F.coalesce(F.col("chosen") == key, F.lit(False)).alias("correct"))


@query("flt03_since_filter", f"{LOG} SELECT id FROM attempts WHERE user_id = 4 AND difficulty = 'hard' AND ts >= TIMESTAMP '2024-01-15'")
def since_filter(spark, sf):
    return attempts(spark, sf).filter((F.col("user_id") == 4) & (F.col("difficulty") == "hard") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))).select("id")


@query("flt06_date_gate", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') <= '1995-03-01'")
def date_gate(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit("1995-03-02").cast("timestamp_ntz")).select("o_orderkey")


@query("flt07_archive_months", "WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), h AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS matches FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 300000 GROUP BY 1) SELECT month, coalesce(matches, 0) AS matches FROM m LEFT JOIN h USING (month)")
def archive_months(spark, sf):
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    hits = o.filter("o_orderpriority LIKE '1%' AND o_totalprice > 300000").groupBy("month").agg(F.count("*").alias("matches"))
    return o.select("month").distinct().join(hits, "month", "left").na.fill(0)


@query("flt13_json_coercion", "SELECT event_id, coalesce(try_cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT), -1) AS k FROM events")
def json_coercion(spark, sf):
    e = table(spark, sf, "events")
    parsed = F.from_json("props", "k int, nested struct<x:int>", {"mode": "PERMISSIVE"})
    return e.select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@query("flt14_row_codec", "SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms FROM events")
def row_codec(spark, sf):
    return table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"))


@query("flt09_ambiguous_ids", f"{BANK} SELECT pi, count(DISTINCT file) AS files, count(DISTINCT file) > 1 AS ambiguous FROM bank GROUP BY pi")
def ambiguous_ids(spark, sf):
    n = F.count_distinct("file")
    return bank(spark, sf).groupBy("pi").agg(n.alias("files"), (n > 1).alias("ambiguous"))


@query("src26_identity_stamp", f"{BANK} SELECT id, split_part(file, '-', 2) AS chunk, file || ':' || id AS row_ref FROM bank")
def identity_stamp(spark, sf):
    return bank(spark, sf).select("id", F.split_part("file", F.lit("-"), F.lit(2)).alias("chunk"), F.concat_ws(":", "file", "id").alias("row_ref"))


def _half(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.lit(1).alias("version"))
    return o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("N"), "version": F.lit(2) - (F.col("o_orderkey") % 5 == 0).cast("int") * 2})


HALF = "WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS day, 1 AS version FROM orders), t AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey, 'N' AS o_orderstatus, day, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS version FROM o WHERE o_orderkey % 2 = 0)"


@query("src17_insert_ignore", f"{HALF} SELECT o_orderkey, o_orderstatus FROM t UNION ALL SELECT o_orderkey, o_orderstatus FROM r ANTI JOIN t USING (o_orderkey)")
def insert_ignore(spark, sf):
    t, r = _half(spark, sf)
    return S.insert_ignore(t, r, ["o_orderkey"], ["version"]).select("o_orderkey", "o_orderstatus")


@query("src18_upsert_latest", f"{HALF} SELECT o_orderkey, o_orderstatus, version FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, new DESC) AS nth FROM (SELECT *, 0 AS new FROM t UNION ALL SELECT *, 1 FROM r)) WHERE nth = 1")
def upsert_latest(spark, sf):
    t, r = _half(spark, sf)
    return S.upsert_latest(t, r, "o_orderkey", "version").select("o_orderkey", "o_orderstatus", "version")


@query("src18_patch_with_nulls", f"{HALF} SELECT t.o_orderkey, CASE WHEN r.version > 0 THEN NULL WHEN r.version = 0 THEN t.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus FROM t LEFT JOIN r USING (o_orderkey)")
def patch_with_nulls(spark, sf):
    t, r = _half(spark, sf)
    patches = r.select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), (F.col("version") > 0).alias("set_o_orderstatus"))
    return S.patch(t, patches, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query("src22_replace_and_retain", f"{HALF}, k AS (SELECT * FROM t ANTI JOIN r USING (o_orderkey) UNION ALL SELECT * FROM r) SELECT o_orderkey, o_orderstatus FROM (SELECT *, max(day) OVER (PARTITION BY o_orderstatus) AS newest FROM k) WHERE day >= newest - 90")
def replace_and_retain(spark, sf):
    t, r = _half(spark, sf)
    return S.replace_and_retain(t, r, ["o_orderkey"], "o_orderstatus", "day", 90).select("o_orderkey", "o_orderstatus")


@query("src23_append_distinct", "WITH log AS (SELECT DISTINCT l_returnflag AS batch, l_linestatus AS term, l_linenumber AS stage FROM lineitem WHERE l_linenumber < 4), rows_ AS (SELECT DISTINCT l_returnflag AS batch, l_linestatus AS term, l_linenumber AS stage FROM lineitem) SELECT * FROM log UNION SELECT * FROM rows_")
def append_distinct(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("batch"), F.col("l_linestatus").alias("term"), F.col("l_linenumber").alias("stage"))
    return S.append_distinct(rows.filter("stage < 4").distinct(), rows, ["batch", "term", "stage"])


@query("src24_drift_check", "WITH a AS (SELECT doc_id AS path, sha256(text) AS x FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS y FROM documents WHERE doc_id % 11 <> 0) SELECT path, state FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN x <> y THEN 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path) WHERE state IS NOT NULL")
def drift_check(spark, sf):
    d = table(spark, sf, "documents")
    a = d.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("h"))
    b = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return S.drift(a, b, "path", "h")


@query("stm04_reset_fencing", "WITH o AS (SELECT event_id AS seq, user_id, CASE WHEN event_id % 97 = 0 THEN 'reset' ELSE event_type END AS kind FROM events) SELECT seq, user_id, kind FROM (SELECT *, max(seq) FILTER (WHERE kind = 'reset') OVER (PARTITION BY user_id) AS r FROM o) WHERE kind <> 'reset' AND (r IS NULL OR seq > r)")
def reset_fencing(spark, sf):
    ops = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id", F.when(F.col("event_id") % 97 == 0, "reset").otherwise(F.col("event_type")).alias("kind"))
    return S.after_reset(ops, "user_id", "seq", "kind")


@query("stm02_outbox_state", "SELECT event_id AS seq, (event_id % 9)::INT AS tries, CASE WHEN event_id % 9 >= 8 THEN 'dead' WHEN event_type = 'error' THEN 'retry' ELSE 'sent' END AS state, least(30000, 1000 * pow(2, least(event_id % 9, 5)))::INT AS wait_ms FROM events")
def outbox_state(spark, sf):
    tries = (F.col("event_id") % 9).cast("int")
    state = F.when(tries >= 8, "dead").when(F.col("event_type") == "error", "retry").otherwise("sent")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), tries.alias("tries"), state.alias("state"), K.backoff_ms(tries).alias("wait_ms"))


def _solvers(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("cand_id"), "p_size")
    one = lambda k: p.select("cand_id", F.substring(F.lit("ABCD"), ((F.col("cand_id") + F.when(F.col("p_size") % 7 == k, 1).otherwise(0)) % 4 + 1).cast("int"), F.lit(1)).alias("answer"))
    keys = p.select("cand_id", F.substring(F.lit("ABCD"), ((F.col("cand_id") + F.when(F.col("p_size") == 12, 2).otherwise(0)) % 4 + 1).cast("int"), F.lit(1)).alias("answer"))
    return keys, one(0).unionByName(one(1))


@query("join14_solver_outcomes", """WITH r AS (SELECT p_partkey AS cand_id, substr('ABCD', ((p_partkey + CASE WHEN p_size % 7 = k THEN 1 ELSE 0 END) % 4 + 1)::INT, 1) AS answer FROM part, range(2) t(k)),
    v AS (SELECT cand_id, count(DISTINCT answer) AS kinds, min(answer) AS said, count(*) AS solvers FROM r GROUP BY ALL)
    SELECT cand_id, solvers, CASE WHEN kinds > 1 THEN 'split' WHEN said <> substr('ABCD', ((p_partkey + CASE WHEN p_size = 12 THEN 2 ELSE 0 END) % 4 + 1)::INT, 1) THEN 'against key' ELSE 'agreed' END AS outcome FROM part JOIN v ON cand_id = p_partkey""")
def solver_outcomes(spark, sf):
    return K.solver_outcomes(*_solvers(spark, sf))


@query("join15_label_join", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 > 0 THEN d.lang END, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END) AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_join(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"))
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"))
    return K.apply_labels(rows, labels, "doc_id", "lang", replace=False)


@query("join16_overlay", "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_nationkey END AS n, 'FIXED' AS s FROM customer WHERE c_custkey % 5 = 0) SELECT c.c_custkey, CASE WHEN n = c_nationkey THEN s ELSE c_mktsegment END AS c_mktsegment, CASE WHEN n IS NULL THEN 'kept' WHEN n = c_nationkey THEN 'repaired' ELSE 'refused' END AS state FROM customer c LEFT JOIN r USING (c_custkey)")
def overlay(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    r = c.filter("c_custkey % 5 = 0").withColumns({"c_nationkey": F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(F.col("c_nationkey")), "c_mktsegment": F.lit("FIXED")})
    return K.overlay(c, r, "c_custkey", ["c_nationkey"], ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "state")


@query("join25_exact_then_loose", f"""WITH asked AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_name || ' new' END AS name FROM part), cat AS (SELECT p_name AS name, min(p_partkey) AS cat_id FROM part GROUP BY 1)
    SELECT p_partkey, coalesce(e.cat_id, l.cat_id) AS cat_id, CASE WHEN e.cat_id IS NOT NULL THEN 'exact' WHEN l.cat_id IS NOT NULL THEN 'loose' ELSE 'none' END AS match FROM asked a LEFT JOIN cat e ON a.name = e.name LEFT JOIN (SELECT {NORM.format('name')} AS norm, min(cat_id) AS cat_id FROM cat GROUP BY 1) l ON {NORM.format('a.name')} = l.norm""")
def exact_then_loose(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" new")))
    return K.exact_then_loose(p.select("p_partkey", name.alias("name")), p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("cat_id")), "name").select("p_partkey", "cat_id", "match")


@query("join21_best_match", f"""WITH w AS (SELECT item_id AS id, list_distinct({TOKENS.format('text')}) AS words FROM benchmark), a AS (SELECT id, unnest(words) AS w, len(words) AS n FROM w),
    p AS (SELECT a.id, b.id AS other, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS score FROM a JOIN a b ON a.w = b.w AND a.id <> b.id GROUP BY a.id, b.id)
    SELECT id, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS nth FROM p) WHERE nth = 1""")
def best_match(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.lit("all").alias("shelf"), F.col("item_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return rounded(K.best_match(rows, rows, "shelf"), "score")


@query("join23_company_reuse", "SELECT id, last_day::VARCHAR AS last_day FROM (SELECT o_orderkey AS id, o_orderdate::DATE AS day, lag(o_orderdate::DATE) OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS last_day FROM orders) WHERE date_diff('day', last_day, day) <= 90")
def company_reuse(spark, sf):
    uses = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"), F.col("o_custkey").alias("name"), F.to_date("o_orderdate").alias("day"))
    return K.reused_within(uses, 90).select("id", F.col("last_day").cast("string").alias("last_day"))


@query("join26_vocab_verdicts", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'reject' WHEN quality = 0 THEN 'drop' WHEN toxic = 1 THEN 'hard' ELSE 'medium' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def vocab_verdicts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("has").isNull(), "reject").when(F.col("quality") == 0, "drop").when(F.col("toxic") == 1, "hard").otherwise("medium").alias("verdict"))


@query("join30_two_lens_census", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS either, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS both_lenses, abs(count(*) FILTER (WHERE quality = 0) - count(*) FILTER (WHERE toxic = 1)) AS spread FROM labels")
def two_lens_census(spark, sf):
    a, b = F.col("quality") == 0, F.col("toxic") == 1
    return table(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if(a | b).alias("either"), F.count_if(a & b).alias("both_lenses"), F.abs(F.count_if(a) - F.count_if(b)).alias("spread"))


@query("join31_batch_vs_bank", f"{BANK} SELECT difficulty, count(*) FILTER (WHERE id % 4 = 0) AS batch, count(*) FILTER (WHERE id % 4 <> 0) AS bank FROM bank GROUP BY difficulty")
def batch_vs_bank(spark, sf):
    rows = bank(spark, sf).withColumn("arm", F.when(F.col("id") % 4 == 0, "batch").otherwise("bank"))
    return rows.groupBy("difficulty").pivot("arm", ["batch", "bank"]).count().na.fill(0)


@query("join36_axis_membership", "WITH axes AS (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderkey < 50) SELECT o_orderkey FROM orders ANTI JOIN axes ON o_orderpriority = value UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')")
def axis_membership(spark, sf):
    o = table(spark, sf, "orders")
    axes = o.filter("o_orderkey < 50").select("o_orderpriority").distinct()
    return o.join(axes, "o_orderpriority", "left_anti").select("o_orderkey").unionByName(o.filter("o_orderstatus NOT IN ('O', 'F', 'P')").select("o_orderkey"))


@query("join17_allowed_areas", f"{BANK} SELECT id FROM bank WHERE (cluster, area) NOT IN (SELECT DISTINCT cluster, area FROM bank WHERE id % 2 = 0)")
def allowed_areas(spark, sf):
    rows = bank(spark, sf)
    return rows.join(rows.filter("id % 2 = 0").select("cluster", "area").distinct(), ["cluster", "area"], "left_anti").select("id")


@query("str15_proper_names", "SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)).list_sort(), '|') AS names FROM documents")
def proper_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(K.proper_names(F.col("text"))), "|").alias("names"))


@query("str26_paragraphs", "SELECT doc_id, unnest(range(1, len(p) + 1)) AS place, unnest(p) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS p FROM documents)")
def paragraphs(spark, sf):
    d = table(spark, sf, "documents")
    # F.trim itself would take the place as its second argument, the characters to trim.
    found = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return d.select("doc_id", F.posexplode(found).alias("place", "paragraph")).select("doc_id", (F.col("place") + 1).alias("place"), "paragraph")


LINES = "lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return d.select("doc_id", (F.col("place") + 1).alias("place"), "line")


@query("str23_headings", f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE length(line) BETWEEN 4 AND 90 AND upper(line) = line AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 GROUP BY doc_id")
def headings(spark, sf):
    return _lines(spark, sf).filter(K.headings(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("str22_gate_log_fill", f"WITH {LINES} SELECT doc_id, place, last_value(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN regexp_extract(line, '^([A-Z][a-z]+) ', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM lines")
def gate_log_fill(spark, sf):
    header = F.when(F.rlike("line", F.lit("^[A-Z][a-z]+ ")), F.regexp_extract("line", "^([A-Z][a-z]+) ", 1))
    return K.fill_forward(_lines(spark, sf), "doc_id", "place", header).select("doc_id", "place", "owner")


SMALL = TOKENS.replace("length(w) >= 3", "length(w) >= 2")


@query("str13_label_divergence", f"{BANK}, o AS (SELECT id, list_distinct({SMALL.format('a')}) AS a, list_distinct({SMALL.format('b')}) AS b, list_distinct({SMALL.format('c')}) AS c, list_distinct({SMALL.format('d')}) AS d FROM bank), n AS (SELECT id, len(list_intersect(list_intersect(list_intersect(a, b), c), d)) AS shared, len(list_distinct(list_concat(list_concat(a, b), list_concat(c, d)))) AS \"union\" FROM o) SELECT id, shared, \"union\", shared * 4 < \"union\" AS barely FROM n")
def label_divergence(spark, sf):
    return K.label_divergence(bank(spark, sf))


@query("str16_definition_restates", "SELECT p_partkey, starts_with('part ' || p_name || ' ', regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN 'the part ' ELSE 'part ' END || p_name, '^(a|an|the) ', '') || ' ') AS restates FROM part")
def definition_restates(spark, sf):
    p = table(spark, sf, "part")
    term, definition = F.concat(F.when(F.col("p_partkey") % 2 == 0, "part ").otherwise("part "), "p_name"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "The part ").otherwise("part "), "p_name")
    return p.select("p_partkey", T.restates(term, definition).alias("restates"))


@query("str27_knob_ids", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_brand || ' F' || p_size || ' K3', '([A-Z][0-9]+)', 1))), ',') AS knobs FROM part")
def knob_ids(spark, sf):
    text = F.concat("p_brand", F.lit(" F"), "p_size", F.lit(" K3"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z][0-9]+)"), 1))), ",").alias("knobs"))


@query("str29_letter_normaliser", "SELECT conv_id, turn, CASE WHEN upper(trim(role)) IN ('SYSTEM', 'NONE') THEN '' ELSE upper(trim(role)) END AS letter FROM conversations")
def letter_normaliser(spark, sf):
    role = F.upper(F.trim("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(role.isin("SYSTEM", "NONE"), "").otherwise(role).alias("letter"))


@query("str30_adjudications", "SELECT doc_id, split_part(x, ':', 1) AS id, CASE WHEN contains(x, ':') THEN substr(x, strpos(x, ':') + 1) END AS reason FROM (SELECT doc_id, source || ':' || lang || ':' || doc_id AS x FROM documents)")
def adjudications(spark, sf):
    parts = F.split(F.concat_ws(":", "source", "lang", "doc_id"), ":", 2)
    return table(spark, sf, "documents").select("doc_id", F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("reason"))


@query("str05_humanize", "SELECT DISTINCT l_shipmode_like AS slug, CASE l_shipmode_like WHEN 'r-f' THEN 'Returned' ELSE upper(substr(l_shipmode_like, 1, 1)) || ' ' || upper(substr(l_shipmode_like, 3, 1)) END AS title FROM (SELECT lower(l_returnflag || '-' || l_linestatus) AS l_shipmode_like FROM lineitem)")
def humanize(spark, sf):
    slugs = table(spark, sf, "lineitem").select(F.lower(F.concat_ws("-", "l_returnflag", "l_linestatus")).alias("slug")).distinct()
    return slugs.select("slug", T.humanize(F.col("slug"), {"r-f": "Returned"}).alias("title"))


@query("agg40_upper_median", "SELECT conv_id, list_sort(list(length(text)))[count(*) // 2 + 1] AS upper_median FROM conversations GROUP BY conv_id")
def upper_median(spark, sf):
    n = F.length("text")
    w = W.partitionBy("conv_id").orderBy("n")
    rows = table(spark, sf, "conversations").select("conv_id", n.alias("n")).withColumns({"at": F.row_number().over(w), "size": F.count("*").over(W.partitionBy("conv_id"))})
    return rows.filter(F.col("at") == F.floor(F.col("size") / 2) + 1).select("conv_id", F.col("n").alias("upper_median"))


@query("agg37_threshold_rates", f"{BANK}, l AS (SELECT id, answer, greatest(length(a), length(b), length(c), length(d)) - list_sort([length(a), length(b), length(c), length(d)])[3] AS gap, CASE answer WHEN 'A' THEN length(a) WHEN 'B' THEN length(b) WHEN 'C' THEN length(c) ELSE length(d) END = greatest(length(a), length(b), length(c), length(d)) AS key_top FROM bank) SELECT t AS threshold, count(*) FILTER (WHERE gap >= t) AS fires, count(*) FILTER (WHERE gap >= t AND key_top) AS hits FROM l, (VALUES (1), (3), (5)) v(t) GROUP BY t")
def threshold_rates(spark, sf):
    lens = F.array_sort(F.transform(B.values(F.col("options")), F.length))
    rows = bank(spark, sf).select((F.get(lens, F.lit(3)) - F.get(lens, F.lit(2))).alias("gap"), (F.length(F.col("options")[F.col("answer")]) == F.get(lens, F.lit(3))).alias("top"))
    rows = rows.select("gap", "top", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("threshold"))
    fires = F.col("gap") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(fires).alias("fires"), F.count_if(fires & F.col("top")).alias("hits"))


@query("agg47_label_inference", "SELECT doc_id, CASE WHEN text LIKE '%token =%' THEN 'secret' WHEN regexp_matches(text, '(?i)license|rights reserved') THEN 'license' WHEN regexp_matches(text, '[#$%&]{3}') THEN 'junk' ELSE 'prose' END AS kind FROM documents")
def label_inference(spark, sf):
    t = F.col("text")
    kind = F.when(F.contains(t, F.lit("token =")), "secret").when(F.rlike(t, F.lit("(?i)license|rights reserved")), "license").when(F.rlike(t, F.lit("[#$%&]{3}")), "junk").otherwise("prose")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("win03_first_level", f"{BANK} SELECT cluster, pi, arg_min(level, CASE level WHEN 'District' THEN 0 WHEN 'Association' THEN 1 ELSE 2 END) AS level FROM bank GROUP BY cluster, pi")
def first_level(spark, sf):
    rank = F.when(F.col("level") == "District", 0).when(F.col("level") == "Association", 1).otherwise(2)
    return bank(spark, sf).groupBy("cluster", "pi").agg(F.min_by("level", rank).alias("level"))


@query("win18_universe_membership", f"{BANK} SELECT id FROM bank SEMI JOIN (SELECT DISTINCT pi FROM bank WHERE level = 'ICDC') USING (pi)")
def universe_membership(spark, sf):
    rows = bank(spark, sf)
    return rows.join(rows.filter("level = 'ICDC'").select("pi").distinct(), "pi", "left_semi").select("id")


@query("ord07_enum_order", f"{BANK} SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY CASE level WHEN 'District' THEN 0 WHEN 'Association' THEN 1 ELSE 2 END, CASE difficulty WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id) AS place FROM bank")
def enum_order(spark, sf):
    rank = lambda c, v: F.array_position(F.array(*map(F.lit, v)), F.col(c))
    rows = bank(spark, sf).select("id", "cluster", rank("level", ["District", "Association", "ICDC"]).alias("level"), rank("difficulty", TIERS).alias("tier"))
    return numbered(rows, ["cluster"], [F.col("level"), F.col("tier"), F.col("id")]).select("id", "place")


@query("ord09_weighted_pick", f"{BANK}, a AS (SELECT cluster, area, count(DISTINCT pi) AS weight FROM bank GROUP BY ALL), k AS (SELECT cluster, area, weight, -ln((('0x' || substr(sha256(cluster || '/' || area), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE) / weight AS key FROM a) SELECT cluster, area, weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY key, area) AS nth FROM k) WHERE nth <= 2")
def weighted_pick(spark, sf):
    areas = bank(spark, sf).groupBy("cluster", "area").agg(F.count_distinct("pi").alias("weight"))
    unit = (F.conv(F.substring(F.sha2(F.concat_ws("/", "cluster", "area"), 256), 1, 12), 16, 10).cast("long") + 1) / F.lit(281474976710657.0)
    rows = areas.withColumn("key", -F.log(unit) / F.col("weight"))
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("cluster").orderBy("key", "area"))).filter("nth <= 2").select("cluster", "area", "weight")


@query("scl13_username_available", "SELECT c_custkey, NOT EXISTS (SELECT 1 FROM supplier WHERE lower(replace(s_name, 'Supplier', 'Customer')) = lower(c_name)) AS available FROM customer")
def username_available(spark, sf):
    taken = table(spark, sf, "supplier").select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("n"), F.lit(True).alias("taken")).distinct()
    c = table(spark, sf, "customer")
    return c.join(taken, F.lower("c_name") == F.col("n"), "left").select("c_custkey", F.col("taken").isNull().alias("available"))


@query("scl09_error_class", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 40 THEN 'permanent' WHEN event_type = 'error' THEN 'transient' ELSE 'unknown' END AS kind FROM events")
def error_class(spark, sf):
    e = F.col("event_type") == "error"
    return table(spark, sf, "events").select("event_id", F.when(e & (F.col("value") > 40), "permanent").when(e, "transient").otherwise("unknown").alias("kind"))


@query("scl10_option_map", f"{BANK} SELECT id, CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END AS key_text, length(a) + length(b) + length(c) + length(d) AS total FROM bank")
def option_map(spark, sf):
    return bank(spark, sf).select("id", F.col("options")[F.col("answer")].alias("key_text"), F.aggregate(F.transform(B.values(F.col("options")), F.length), F.lit(0), lambda s, x: s + x).alias("total"))


@query("scl11_cost_model", f"{BANK} SELECT file, count(*) AS items, sum(length(question))::BIGINT AS chars, (65000 + 850 * count(*) + sum(length(question)) // 4)::BIGINT AS tokens FROM bank GROUP BY file")
def cost_model(spark, sf):
    n, chars = F.count("*"), F.sum(F.length("question"))
    return bank(spark, sf).groupBy("file").agg(n.alias("items"), chars.alias("chars"), (65_000 + 850 * n + F.floor(chars / 4)).alias("tokens"))


@query("dom25_day_index", "SELECT strftime(ts, '%Y-%m-%d') AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS present, (SELECT count(DISTINCT event_type) FROM events) - count(DISTINCT event_type) AS missing FROM events GROUP BY 1")
def day_index(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.agg(F.count_distinct("event_type").alias("kinds"))
    days = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("present"))
    return days.join(F.broadcast(kinds)).select("day", F.array_join("present", ",").alias("present"), (F.col("kinds") - F.size("present")).alias("missing"))


@query("dom17_verification_scope", f"{BANK} SELECT id FROM bank WHERE difficulty = 'hard' UNION SELECT doc_id FROM labels WHERE quality = 0")
def verification_scope(spark, sf):
    return bank(spark, sf).filter("difficulty = 'hard'").select("id").union(table(spark, sf, "labels").filter("quality = 0").select("doc_id")).distinct()


@query("dom07_assemble", f"""{BANK}, good AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY file, pos) AS c1 FROM hashed WHERE {" AND ".join(f"length({x}) > 0" for x in "abcd")}),
    k AS (SELECT *, row_number() OVER (PARTITION BY stem_hash, cluster, level ORDER BY file, pos) AS c2 FROM good WHERE c1 = 1) SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY file, pos) AS new_id FROM k WHERE c2 = 1""")
def assemble(spark, sf):
    from lumenbank.sources.adapters import hashed_bank

    rows = hashed_bank(spark, sf).filter(F.forall(B.values(F.col("options")), lambda o: F.length(o) > 0))
    rows = B.keep_first(rows, ["content_hash"], ["file", "pos"])
    rows = B.keep_first(rows, ["stem_hash", "cluster", "level"], ["file", "pos"])
    return numbered(rows.select("id", "cluster", "file", "pos"), ["cluster"], [F.col("file"), F.col("pos")], "new_id").select("id", "cluster", "new_id")


@query("dom14_repair_payload", f"{BANK}, l AS (SELECT id, file, list_sort([length(a), length(b), length(c), length(d)]) AS s FROM bank) SELECT id, s[4] - s[3] AS gap, row_number() OVER (PARTITION BY file ORDER BY s[4] - s[3] DESC, id) AS place FROM l WHERE s[4] - s[3] >= 2")
def repair_payload(spark, sf):
    lens = F.array_sort(F.transform(B.values(F.col("options")), F.length))
    rows = bank(spark, sf).select("id", "file", (F.get(lens, F.lit(3)) - F.get(lens, F.lit(2))).alias("gap")).filter("gap >= 2")
    return numbered(rows, ["file"], [F.desc("gap"), F.col("id")]).select("id", "gap", "place")


@query("join12_arm_verification", f"{BANK}, t AS (SELECT id, pos, question AS q, CASE WHEN id % 6 = 0 THEN upper(question) ELSE question END AS q2, a, CASE WHEN id % 2 = 0 THEN a || '.' ELSE a END AS a2 FROM bank) SELECT count(*) AS n, count(*) FILTER (WHERE q <> q2) AS stem_drift, count(*) FILTER (WHERE a = a2) AS same_options FROM t")
def arm_verification(spark, sf):
    b = bank(spark, sf).select("id", "pos", "question", F.col("options")["A"].alias("a"))
    other = b.select("id", "pos", F.when(F.col("id") % 6 == 0, F.upper("question")).otherwise(F.col("question")).alias("q2"), F.when(F.col("id") % 2 == 0, F.concat("a", F.lit("."))).otherwise(F.col("a")).alias("a2"))
    return b.join(other, ["pos", "id"]).agg(F.count("*").alias("n"), F.count_if(F.col("question") != F.col("q2")).alias("stem_drift"), F.count_if(F.col("a") == F.col("a2")).alias("same_options"))


@query("set06_dangling_words", f"{BANK}, w AS (SELECT id, list_distinct({TOKENS.format('question')}) AS old, list_distinct({TOKENS.format('substr(question, 1, 40)')}) AS new, list_distinct({TOKENS.format('explanation')}) AS used FROM bank) SELECT id, len(list_filter(old, lambda x: NOT list_contains(new, x))) AS removed, len(list_filter(old, lambda x: NOT list_contains(new, x) AND list_contains(used, x))) AS dangling FROM w")
def dangling_words(spark, sf):
    words = lambda c: F.array_distinct(T.tokens(c))
    rows = bank(spark, sf).select("id", words(F.col("question")).alias("old"), words(F.substring("question", 1, 40)).alias("new"), words(F.col("explanation")).alias("used"))
    gone = F.array_except("old", "new")
    return rows.select("id", F.size(gone).alias("removed"), F.size(F.array_intersect(gone, F.col("used"))).alias("dangling"))


@query("agg46_compliance_counts", f"{BANK} SELECT file, count(*) FILTER (WHERE CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END = a) AS key_is_a, sum((length(a) > 14)::INT + (length(b) > 14)::INT + (length(c) > 14)::INT + (length(d) > 14)::INT)::BIGINT AS over_band FROM bank GROUP BY file")
def compliance_counts(spark, sf):
    over = F.size(F.filter(B.values(F.col("options")), lambda o: F.length(o) > 14))
    return bank(spark, sf).groupBy("file").agg(F.count_if(F.col("options")[F.col("answer")] == F.col("options")["A"]).alias("key_is_a"), F.sum(over).alias("over_band"))
