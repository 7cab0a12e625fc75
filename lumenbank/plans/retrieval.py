"""Queries on files, archives, resolvers and small plans, each with its SQL.

Those on files write the rows to a new folder under the shared checkpoint folder first, then read them back by
the source under test.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators import retrieval as R
from lumenbank.sources import files as S
from lumenbank.sources.adapters import ATTEMPTS_SQL, BANK_SQL, attempts, bank, table
from lumenbank.streaming.live import scratch

QUERIES, ORACLES = {}, {}
BANK, LOG = f"WITH {BANK_SQL}", f"WITH {ATTEMPTS_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _bank_files(spark, sf) -> str:
    """The benchmark as bank files: a folder per set, each with one JSON array of questions."""
    place = scratch(spark)
    items = table(spark, sf, "benchmark").select((F.col("item_id") % 4).alias("set"), F.struct(F.format_string("b-%04d", "item_id").alias("id"), F.lit("en").alias("cluster"), F.col("text").alias("question"), F.when(F.col("item_id") % 5 == 0, "HARD").otherwise("none").alias("difficulty")).alias("q"))
    # A bank file is one array by its format; the published test is a few hundred items.
    arrays = items.groupBy("set").agg(F.to_json(F.array_sort(F.collect_list("q"))).alias("value"))
    arrays.repartition("set").write.partitionBy("set").text(place)
    return place


FILES = "SELECT format('b-{:04d}', item_id) AS id, item_id % 4 AS part, text AS question, CASE WHEN item_id % 5 = 0 THEN 'hard' ELSE 'medium' END AS difficulty FROM benchmark"


@query("src01_scan_file", f"SELECT id, difficulty, length(question) AS chars FROM ({FILES}) WHERE part = 1")
def scan_file(spark, sf):
    return S.scan_bank(spark, f"{_bank_files(spark, sf)}/set=1").select("id", "difficulty", F.length("question").alias("chars"))


@query("src06_bank_order", f"SELECT id, row_number() OVER (ORDER BY part, id) AS place FROM ({FILES})")
def bank_order(spark, sf):
    # Place in a file is stored; the files before it are counted, so no row is sorted among all.
    rows = S.scan_bank(spark, f"{_bank_files(spark, sf)}/*")
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("file", "before")
    return rows.join(F.broadcast(before), "file").select("id", (F.col("before") + F.col("pos") + 1).alias("place"))


@query("src08_strict_parts", f"SELECT part AS set, count(*) AS n, min(id) AS first_id FROM ({FILES}) GROUP BY part")
def strict_parts(spark, sf):
    rows = S.scan_bank(spark, f"{_bank_files(spark, sf)}/*", strict=True)
    return rows.groupBy(F.regexp_extract("file", "set=([0-9]+)", 1).cast("int").alias("set")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("src07_scan_cluster", f"{BANK} SELECT id, level, length(question) AS chars FROM bank WHERE cluster = 'de'")
def scan_cluster(spark, sf):
    place = scratch(spark)
    S.write_bank(bank(spark, sf).select("id", "cluster", "level", "section", "question"), place)
    return spark.read.parquet(place).filter("cluster = 'de'").select("id", "level", F.length("question").alias("chars"))


@query("src09_snapshot", f"{BANK} SELECT id, CASE WHEN difficulty = 'hard' THEN 'old' ELSE 'same' END AS state FROM bank")
def snapshot(spark, sf):
    place, rows = scratch(spark), bank(spark, sf).select("id", "question", "difficulty")
    S.write_snapshot(rows.withColumn("question", F.when(F.col("difficulty") == "hard", F.lit("before")).otherwise(F.col("question"))), place, "first")
    S.write_snapshot(rows, place, "second")
    then, now = (S.read_snapshot(spark, place, ref).select("id", F.col("question").alias(ref)) for ref in ("first", "second"))
    return then.join(now, "id").select("id", F.when(F.col("first").eqNullSafe(F.col("second")), "same").otherwise("old").alias("state"))


@query("src12_vocab_lines", "SELECT p_partkey, p_name AS term FROM part")
def vocab_lines(spark, sf):
    place = scratch(spark)
    table(spark, sf, "part").select(F.concat(F.lit(" - "), "p_partkey", F.lit("|"), "p_name", F.lit("  # a note")).alias("value")).write.text(place)
    parts = F.split("line", r"\|")
    return S.scan_lines(spark, place).select(parts[0].cast("long").alias("p_partkey"), parts[1].alias("term"))


@query("src13_blocks", "SELECT item_id, replace(text, chr(10), ' ') AS question, item_id % 3 <> 0 AS valid FROM benchmark")
def blocks(spark, sf):
    place = scratch(spark)
    item = F.col("item_id").cast("string")
    label = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    text = F.concat(label("Question", F.replace("text", F.lit("\n"), F.lit(" "))), *[label(x, item) for x in "ABCD"], label("Answer", F.lit("A")), F.when(F.col("item_id") % 3 != 0, label("Explanation", item)).otherwise(""))
    table(spark, sf, "benchmark").select(text.alias("value")).write.text(place)
    found = S.read_blocks(S.scan_blocks(spark, place))
    return found.select(F.col("options")["A"].cast("long").alias("item_id"), "question", "valid")


@query("src20_set_sink", f"{BANK} SELECT file, count(*) AS n, count(*) FILTER (WHERE difficulty = 'hard') AS hard FROM bank GROUP BY file")
def set_sink(spark, sf):
    """The manifest is taken anew from what the sink wrote."""
    place = scratch(spark)
    S.write_bank(bank(spark, sf).select("id", "cluster", "level", "section", "difficulty"), place)
    return spark.read.parquet(place).groupBy(F.concat_ws("-", "cluster", "level", "section").alias("file")).agg(F.count("*").alias("n"), F.count_if(F.col("difficulty") == "hard").alias("hard"))


@query("src03_scan_set", f"{BANK} SELECT id, pos FROM bank WHERE cluster = 'en' AND level = 'District' AND section = 'sets'")
def scan_set(spark, sf):
    return R.scan_slice(bank(spark, sf), "en", "District", "sets").select("id", "pos")


@query("src05_batched_resolver", f"""{BANK}, q AS (SELECT id, cluster, CASE WHEN id % 7 = 0 THEN 'ICDC' ELSE level END AS level FROM bank WHERE cluster <> 'es' UNION ALL SELECT id + 100000000, cluster, level FROM bank UNION ALL SELECT id, 'none', level FROM bank)
    SELECT q.cluster, q.level, q.id, b.question FROM (SELECT DISTINCT * FROM q) q JOIN bank b ON b.id = q.id AND b.cluster = q.cluster AND b.level = q.level""")
def batched_resolver(spark, sf):
    rows = bank(spark, sf)
    asked = rows.filter("cluster <> 'es'").select("id", "cluster", F.when(F.col("id") % 7 == 0, "ICDC").otherwise(F.col("level")).alias("level"))
    asked = asked.unionByName(rows.select((F.col("id") + 100_000_000).alias("id"), "cluster", "level")).unionByName(rows.select("id", F.lit("none").alias("cluster"), "level"))
    return R.resolve(asked, rows.select("id", "cluster", "level", "question"))


DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type FROM events"


def _archive(spark, sf) -> str:
    """Day records of the event log, in a folder for each month: one record of each event, some without a kind, and a line that is no JSON."""
    place = scratch(spark)
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))).alias("value"))
    e.unionByName(spark.createDataFrame([("1999-01", "{broken")], "month string, value string")).repartition("month").write.partitionBy("month").text(place)
    return place


@query("src10_archive", f"WITH d AS ({DAYS}) SELECT day, min(event_id) AS ordinal, coalesce(nullif(arg_min(event_type, event_id), 'error'), 'unrecorded') AS kind FROM d GROUP BY day")
def archive(spark, sf):
    return R.scan_archive(spark, _archive(spark, sf), "date string, ordinal long, kind string", {"kind": "unrecorded"}).withColumnRenamed("date", "day")


@query("src28_archive_days", f"WITH d AS ({DAYS}) SELECT substr(day, 1, 7) AS month, count(DISTINCT day) AS days FROM d GROUP BY 1")
def archive_days(spark, sf):
    """Months come from the folders, so a reader that asks for one month opens no other."""
    rows = spark.read.schema("date string, month string").json(_archive(spark, sf)).filter("month >= '2000-01'")
    return rows.groupBy("month").agg(F.count_distinct("date").alias("days"))


@query("src11_scan_shelf", "SELECT p_brand AS shelf, p_brand || '-' || p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part")
def scan_shelf(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("shelf"), F.concat_ws("-", "p_brand", "p_partkey").alias("id"))
    return R.shelf_order(rows)


@query("src19_export_import", f"{LOG} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE correct) AS correct FROM attempts GROUP BY user_id")
def export_import(spark, sf):
    """A part of the log is there already; the export is imported twice."""
    place = scratch(spark)
    rows = attempts(spark, sf).select("id", "user_id", "correct")
    rows.write.json(place)
    read = spark.read.schema("id long, user_id long, correct boolean").json(place)
    there = rows.filter("correct")
    return R.import_rows(R.import_rows(there, read), read).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query("src29_curated_sets", f"{BANK}, c AS (SELECT DISTINCT area, pi FROM bank JOIN labels ON doc_id = id AND quality = 1) SELECT DISTINCT area, pi, true AS curated FROM c UNION SELECT DISTINCT area, pi, false FROM bank WHERE area NOT IN (SELECT area FROM c)")
def curated_sets(spark, sf):
    rows = bank(spark, sf)
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return R.curated_or_all(rows.join(good, "id", "left_semi").select("area", "pi").distinct(), rows)


@query("src32_text_report", "SELECT p_partkey, 'Part ' || p_partkey || chr(10) || '  name:  ' || p_name || chr(10) || '  brand: ' || p_brand || chr(10) || '  size:  ' || p_size || ' (' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || ')' AS report FROM part")
def text_report(spark, sf):
    size = F.concat("p_size", F.lit(" ("), F.when(F.col("p_size") > 25, "large").otherwise("small"), F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", R.report(F.concat(F.lit("Part "), "p_partkey"), {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": size}).alias("report"))


@query("flt18_gate_only_complete", "WITH g AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders), p AS (SELECT l_orderkey, count(*) AS parts, max(l_linenumber) AS batches, max(l_shipdate) AS newest FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN parts <> batches THEN 'incomplete' WHEN newest > o_orderdate + INTERVAL 90 DAY THEN 'stale' ELSE 'gate' END AS verdict FROM g JOIN p ON l_orderkey = o_orderkey")
def gate_only_complete(spark, sf):
    """A gate runs only where all batches have a part, and no part is newer than the gate's log (90 days after the order)."""
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("parts"), F.max("l_linenumber").alias("batches"), F.max("l_shipdate").alias("newest"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(parts, "o_orderkey")
    late = F.col("newest") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")
    return rows.select("o_orderkey", F.when(F.col("parts") != F.col("batches"), "incomplete").when(late, "stale").otherwise("gate").alias("verdict"))


@query("join32_payload_identity", f"""{BANK}, a AS (SELECT doc_id AS id, 'authored' AS area, CASE quality WHEN 1 THEN 'easy' WHEN 0 THEN 'hard' END AS difficulty FROM labels)
    SELECT a.id, b.area AS area, b.pi AS pi, coalesce(a.difficulty, b.difficulty) AS difficulty FROM a JOIN bank b USING (id)""")
def payload_identity(spark, sf):
    authored = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("authored").alias("area"), F.lit(None).cast("string").alias("pi"), F.when(F.col("quality") == 1, "easy").when(F.col("quality") == 0, "hard").alias("difficulty"))
    payload = bank(spark, sf).select("id", F.col("area").alias("instructional_area"), "pi", "difficulty")
    return R.payload_identity(authored, payload, {"area": "instructional_area", "pi": "pi"}, ["difficulty"])


@query("agg39_cost_ledger", f"{LOG} SELECT cluster, difficulty, count(*) AS calls, sum(elapsed_ms)::BIGINT AS spent, round(avg(elapsed_ms), 6) AS per_call, round(sum(elapsed_ms) / sum(sum(elapsed_ms)) OVER (PARTITION BY cluster), 6) AS share FROM attempts GROUP BY cluster, difficulty")
def cost_ledger(spark, sf):
    rows = attempts(spark, sf).groupBy("cluster", "difficulty").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("spent"), F.round(F.avg("elapsed_ms"), 6).alias("per_call"))
    return rows.withColumn("share", F.round(F.col("spent") / F.sum("spent").over(W.partitionBy("cluster")), 6))


@query("ord04_weighted_sample")
def weighted_sample(spark, sf):
    """Without a seed of its own the order differs from run to run; tests look at what any order must satisfy."""
    weight = F.when(F.col("difficulty") == "hard", 3.0).otherwise(1.0)
    return R.weighted_sample(bank(spark, sf).select("id", "cluster", weight.alias("weight")), 50)


@query("scl14_mint_ids")
def mint_ids(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.uuid().alias("uuid"))


@query("scl15_titles", "SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'Opened a link' WHEN 'view' THEN 'Read a page' ELSE lower(event_type) END AS title FROM events")
def titles(spark, sf):
    known = F.create_map(*[F.lit(x) for kv in {"click": "Opened a link", "view": "Read a page"}.items() for x in kv])
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", F.coalesce(known[F.col("event_type")], F.lower("event_type")).alias("title"))


@query("dom06_manual_task", f"""{BANK}, u AS (SELECT DISTINCT cluster, area, pi FROM bank JOIN labels ON doc_id = id), kinds AS (SELECT * FROM (VALUES ('practice', 10), ('review', 5), ('flashcards', 20)) k(kind, questions)),
    f AS (SELECT cluster, min(area || '/' || pi) AS first FROM (SELECT DISTINCT cluster, area, pi FROM bank EXCEPT SELECT * FROM u) GROUP BY cluster)
    SELECT c.cluster, kind, CASE WHEN kind = 'flashcards' THEN NULL ELSE first END AS target, questions FROM (SELECT DISTINCT cluster FROM bank) c CROSS JOIN kinds LEFT JOIN f USING (cluster)""")
def manual_task(spark, sf):
    rows = bank(spark, sf)
    used = rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return R.manual_tasks(rows, used)


@query("dom21_work_order", f"{BANK} SELECT area, CASE WHEN count(*) >= 60 THEN 0 ELSE 60 - count(*) END AS owed, count(*) FILTER (WHERE length(trim(question, ' ')) < 40) AS short, count(*) FILTER (WHERE answer IS NULL) AS unanswered FROM bank GROUP BY area")
def work_order(spark, sf):
    return R.work_order(bank(spark, sf), 60)
