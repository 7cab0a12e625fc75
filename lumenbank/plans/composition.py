"""Queries that compose sets, plans and calendars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators import bank as B
from lumenbank.operators import compose as C
from lumenbank.operators import mastery as M
from lumenbank.operators.ranks import numbered, placed, tiles
from lumenbank.plans.progress import READY_SQL, WHOLE, rounded
from lumenbank.sources.adapters import ATTEMPTS_SQL, BANK_SQL, LETTERS, attempts, bank, blueprint, table, universe

QUERIES, ORACLES = {}, {}
BANK, LOG = f"WITH {BANK_SQL}", f"WITH {ATTEMPTS_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("ord03_seeded_shuffle", f"{BANK} SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY sha256(id || ':7'), id) AS place FROM bank")
def seeded_shuffle(spark, sf):
    return C.shuffled_whole(bank(spark, sf).select("id", "cluster"), 7, ["cluster"]).select("id", "place")


@query("ord05_balanced_letters", f"{BANK} SELECT id, substr('ABCD', ((row_number() OVER (PARTITION BY file ORDER BY sha256(id || ':11'), id) - 1) % 4 + 1)::INT, 1) AS letter FROM bank")
def balanced_letters(spark, sf):
    return C.balanced_values(bank(spark, sf).select("id", "file"), LETTERS, 11, ["file"], "letter").select("id", "letter")


@query("ord06_rotation_pick", "SELECT p_name || ':' || p_partkey AS key, ['north', 'south', 'east', 'west', 'up'][('0x' || substr(sha256(p_name || ':' || p_partkey), 1, 15))::BIGINT % 5 + 1] AS pick FROM part")
def rotation_pick(spark, sf):
    keys = table(spark, sf, "part").select(F.concat_ws(":", "p_name", "p_partkey").alias("key"))
    return C.rotation_pick(keys, ["north", "south", "east", "west", "up"])


QUOTA_SQL = """n AS (SELECT cluster, area, count(*) AS n FROM bank GROUP BY ALL), e AS (SELECT *, 20 * n / sum(n) OVER (PARTITION BY cluster)::DOUBLE AS exact FROM n),
    f AS (SELECT *, floor(exact)::BIGINT AS whole, row_number() OVER (PARTITION BY cluster ORDER BY round(exact - floor(exact), 9) DESC, area) AS place FROM e),
    quotas AS (SELECT cluster, area, n, whole + CASE WHEN place <= 20 - sum(whole) OVER (PARTITION BY cluster) THEN 1 ELSE 0 END AS quota FROM f)"""


def _quotas(spark, sf):
    return C.question_quotas(bank(spark, sf).groupBy("cluster", "area").agg(F.count("*").alias("n")), 20, ["cluster"])


@query("scl07_area_allocation", f"{BANK}, {QUOTA_SQL} SELECT * FROM quotas")
def area_allocation(spark, sf):
    return _quotas(spark, sf)


@query("dom01_plan_questions", f"{BANK}, {QUOTA_SQL}, o AS (SELECT id, cluster, area, row_number() OVER (PARTITION BY cluster, area ORDER BY sha256(id || ':3'), id) AS place FROM bank) SELECT id, cluster, area, place FROM o JOIN quotas USING (cluster, area) WHERE place <= quota")
def plan_questions(spark, sf):
    return C.draw(bank(spark, sf).select("id", "cluster", "area"), _quotas(spark, sf), ["cluster", "area"], 3).select("id", "cluster", "area", "place")


@query("dom02_compose_test", f"""{BANK}, o AS (SELECT id, cluster, difficulty, row_number() OVER (PARTITION BY cluster, difficulty ORDER BY sha256(id || ':5'), id) AS place FROM bank),
    b AS (SELECT *, place > CASE difficulty WHEN 'easy' THEN 5 WHEN 'medium' THEN 8 ELSE 12 END AS borrowed, CASE difficulty WHEN 'medium' THEN 0 ELSE 1 END AS near FROM o),
    s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY borrowed, near, place, id) AS slot FROM b) SELECT id, cluster, difficulty, borrowed, slot FROM s WHERE slot <= 25""")
def compose_test(spark, sf):
    return C.compose_test(bank(spark, sf), {"easy": 5, "medium": 8, "hard": 12}, "cluster", 5)


@query("dom04_diagnostic_sample", f"""{BANK}, o AS (SELECT id, cluster, difficulty, row_number() OVER (PARTITION BY cluster, difficulty ORDER BY sha256(id || ':11'), id) AS place FROM bank),
    b AS (SELECT *, place > 6 AS borrowed, CASE difficulty WHEN 'medium' THEN 0 ELSE 1 END AS near FROM o),
    s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY borrowed, near, place, id) AS slot FROM b) SELECT id, cluster, difficulty, borrowed, slot FROM s WHERE slot <= 18""")
def diagnostic_sample(spark, sf):
    """A balanced test of 18; a cluster without questions has none."""
    return C.compose_test(bank(spark, sf), {"easy": 6, "medium": 6, "hard": 6}, "cluster", 11)


@query("dom03_draw_pi_questions", f"""{BANK}, asked AS (SELECT DISTINCT cluster, area, pi FROM bank), c AS (SELECT a.cluster, a.area, a.pi, b.id, CASE WHEN b.pi = a.pi THEN 0 ELSE 1 END AS rank FROM asked a JOIN bank b USING (cluster, area)),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster, area, pi ORDER BY rank, sha256(id || ':9'), id) AS place FROM c) SELECT cluster, area, pi, id, place, CASE rank WHEN 0 THEN 'pi' ELSE 'area' END AS source FROM p WHERE place <= 4""")
def draw_pi_questions(spark, sf):
    rows = bank(spark, sf).select("id", "cluster", "area", "pi")
    return C.draw_for_indicator(rows, rows.select("cluster", "area", "pi").distinct(), 4, 9)


@query("join06_exclude_answered", f"{BANK} SELECT id FROM bank ANTI JOIN (SELECT doc_id AS id FROM labels) USING (id)")
def exclude_answered(spark, sf):
    return bank(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id")


@query("join05_availability", f"{BANK}, t AS (SELECT cluster, area, pi, count(*) AS n, bool_or(id IN (SELECT doc_id FROM labels)) AS seen FROM bank GROUP BY ALL), u AS (SELECT cluster, area, count(*) AS left_ FROM bank WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL) SELECT t.cluster, t.area, t.pi, CASE WHEN seen THEN n ELSE coalesce(left_, 0) END AS available FROM t LEFT JOIN u USING (cluster, area)")
def availability(spark, sf):
    rows = bank(spark, sf).select("id", "cluster", "area", "pi")
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("done")).distinct()
    marked = rows.join(done, "id", "left")
    total = marked.groupBy("cluster", "area", "pi").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("seen"))
    left = marked.groupBy("cluster", "area").agg(F.count_if(F.col("done").isNull()).alias("left"))
    return total.join(left, ["cluster", "area"], "left").select("cluster", "area", "pi", F.when(F.col("seen"), F.col("n")).otherwise(F.coalesce("left", F.lit(0))).alias("available"))


@query("join04_errors_lookup", f"{LOG} SELECT user_id, count(*) AS missed, count(*) FILTER (WHERE p_partkey IS NULL) AS unresolved FROM (SELECT DISTINCT user_id, question_id FROM attempts WHERE NOT correct) LEFT JOIN (SELECT p_partkey, 'q-' || p_partkey AS question_id FROM part WHERE p_partkey % 3 > 0) USING (question_id) GROUP BY user_id")
def errors_lookup(spark, sf):
    missed = attempts(spark, sf).filter("NOT correct").select("user_id", "question_id").distinct()
    known = table(spark, sf, "part").filter("p_partkey % 3 > 0").select(F.concat(F.lit("q-"), "p_partkey").alias("question_id"), "p_partkey")
    return missed.join(known, "question_id", "left").groupBy("user_id").agg(F.count("*").alias("missed"), F.count_if(F.col("p_partkey").isNull()).alias("unresolved"))


USERS_SQL = """users AS (SELECT user_id, tries, readiness, days_left FROM (SELECT user_id, count(*) AS tries FROM attempts GROUP BY ALL) JOIN (SELECT user_id, avg(readiness) AS readiness FROM ready GROUP BY ALL) USING (user_id), LATERAL (SELECT user_id * 3 AS days_left))"""


@query("dom05_study_plan", f"""{WHOLE}, {READY_SQL}, {USERS_SQL}, weakarea AS (SELECT user_id, cluster, area FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(mastery, 9), cluster, area) AS p FROM areas) WHERE p = 1),
    tasks AS (SELECT user_id, 0 AS rule, 'warm-up' AS task, NULL AS pi FROM users WHERE tries < 12
        UNION ALL SELECT user_id, 1, 'weak', cluster || '/' || area || '/' || pi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(mastery, 9), cluster, area, pi) AS p FROM whole WHERE seen AND mastery < 0.6) WHERE p <= 3
        UNION ALL SELECT user_id, 2, 'uncovered', cluster || '/' || area || '/' || pi FROM (SELECT w.*, row_number() OVER (PARTITION BY user_id ORDER BY pi) AS p FROM whole w JOIN weakarea USING (user_id, cluster, area) WHERE NOT seen) WHERE p <= 2
        UNION ALL SELECT user_id, 3, 'challenge', NULL FROM users WHERE readiness >= 0.6
        UNION ALL SELECT user_id, 4, 'milestone', NULL FROM users WHERE readiness >= 0.75 OR days_left <= 10)
    SELECT user_id, rule, task, pi, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rule, pi NULLS FIRST) AS place FROM tasks) WHERE place <= 5""")
def study_plan(spark, sf):
    log = attempts(spark, sf)
    stats = M.universe_stats(log, universe(spark, sf))
    areas = M.area_mastery(stats)
    ready = M.readiness(areas, blueprint(spark)).groupBy("user_id").agg(F.avg("readiness").alias("readiness"))
    users = log.groupBy("user_id").agg(F.count("*").alias("tries")).join(ready, "user_id").withColumn("days_left", F.col("user_id") * 3)
    return C.study_plan(stats, areas, users)


@query("scl05_pacing", """WITH p AS (SELECT o_orderkey AS id, o_orderdate::DATE AS start_day, (o_orderdate + INTERVAL 90 DAY)::DATE AS event_day, DATE '1995-06-17' AS today, (o_orderkey % 100) / 100.0::DOUBLE AS readiness FROM orders),
    e AS (SELECT *, greatest(date_diff('day', today, event_day), 0)::INT AS days_left, 0.82 * least(greatest(date_diff('day', start_day, today) / 90.0::DOUBLE, 0.0), 1.0) AS expected FROM p)
    SELECT id, days_left, round(expected, 6) AS expected, CASE WHEN readiness > expected + 0.06 THEN 'ahead' WHEN readiness < expected - 0.06 THEN 'behind' ELSE 'on track' END AS pace FROM e""")
def pacing(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start_day"), F.date_add(F.to_date("o_orderdate"), 90).alias("event_day"), F.lit("1995-06-17").cast("date").alias("today"), ((F.col("o_orderkey") % 100) / 100.0).alias("readiness"))
    return rounded(C.pacing(o).select("id", "days_left", "expected", "pace"), "expected")


@query("ord02_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def page(spark, sf):
    return C.page(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 2, 25)


@query("scl08_length_ladder", "SELECT p_partkey, array_to_string(list_transform(range(1, 5), lambda i: round_even(p_size + (p_size * 2 + 7 - p_size) / 5.0 * i, 0)::INT), ',') AS ladder FROM part")
def ladder(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", F.array_join(C.ladder(F.col("p_size").cast("double"), (F.col("p_size") * 2 + 7).cast("double")), ",").alias("ladder"))


@query("scl02_eastern_day", "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day FROM events")
def eastern_day(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd").alias("day"))


@query("scl04_month_labels", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%B %Y') AS label, strftime(o_orderdate, '%a') AS weekday FROM orders")
def month_labels(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "MMMM yyyy").alias("label"), F.date_format("o_orderdate", "EEE").alias("weekday"))


@query("win11_day_neighbours", "WITH d AS (SELECT DISTINCT ts::DATE::VARCHAR AS day FROM events WHERE event_type = 'error') SELECT day, row_number() OVER w AS number, lag(day) OVER w AS previous, lead(day) OVER w AS next FROM d WINDOW w AS (ORDER BY day)")
def day_neighbours(spark, sf):
    # Days, not events, meet in the one ordered window.
    days = table(spark, sf, "events").filter("event_type = 'error'").select(F.to_date("ts").cast("string").alias("day")).distinct()
    w = W.orderBy("day")
    return days.select("day", F.row_number().over(w).alias("number"), F.lag("day").over(w).alias("previous"), F.lead("day").over(w).alias("next"))


@query("win12_recent_window", "SELECT a.event_id, count(b.event_id) AS before FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts::DATE >= a.ts::DATE - 5 AND b.ts::DATE < a.ts::DATE GROUP BY a.event_id")
def recent_window(spark, sf):
    day = F.unix_date(F.to_date("ts"))
    w = W.partitionBy("user_id").orderBy("day").rangeBetween(-5, -1)
    rows = table(spark, sf, "events").select("event_id", "user_id", day.alias("day"))
    return rows.withColumn("before", F.count("*").over(w)).select("event_id", "before")


@query("win08_rank_of_row", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rank, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC), 6) AS share FROM customer")
def rank_of_row(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return rounded(table(spark, sf, "customer").select("c_custkey", F.rank().over(w).alias("rank"), F.percent_rank().over(w).alias("share")), "share")


@query("win10_next_ids", "WITH m AS (SELECT max(p_partkey) AS m FROM part WHERE p_size < 40) SELECT p_partkey, CASE WHEN p_size < 40 THEN p_partkey ELSE m + row_number() OVER (PARTITION BY p_size < 40 ORDER BY p_partkey) END AS new_id FROM part, m")
def next_ids(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") < 40).alias("has"))
    top = rows.filter("has").agg(F.max("p_partkey").alias("m"))
    # Only rows without an id are numbered, beside the one row of the highest id.
    fresh = numbered(rows.filter("NOT has").select("p_partkey"), [], [F.col("p_partkey")])
    fresh = fresh.join(F.broadcast(top)).select("p_partkey", (F.col("m") + F.col("place")).alias("new_id"))
    return rows.filter("has").select("p_partkey", F.col("p_partkey").cast("long").alias("new_id")).unionByName(fresh)


@query("agg41_event_tags", "SELECT event_type, string_agg(DISTINCT k, ',' ORDER BY k) AS tags, count(*) AS terms, count(*) FILTER (WHERE value >= 60) * 2 >= count(*) AS half_hard FROM (SELECT event_type, value, regexp_extract(props, '(\\d+)', 1) AS k FROM events) GROUP BY event_type")
def event_tags(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1))
    return rows.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("tags"), F.count("*").alias("terms"), (F.count_if(F.col("value") >= 60) * 2 >= F.count("*")).alias("half_hard"))


@query("agg42_shelf_depths", "SELECT n_nationkey AS shelf, n_name, count(s_suppkey) AS depth, count(s_suppkey) = 0 OR count(s_suppkey) = min(count(s_suppkey)) OVER () AS thinnest FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def shelf_depths(spark, sf):
    depth = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("shelf"), "n_name").agg(F.count("s_suppkey").alias("depth"))
    least = depth.agg(F.min("depth").alias("least"))
    return depth.join(F.broadcast(least)).select("shelf", "n_name", "depth", ((F.col("depth") == 0) | (F.col("depth") == F.col("least"))).alias("thinnest"))


@query("agg36_in_area_support", f"{BANK}, s AS (SELECT cluster, area, pi, count(DISTINCT level) AS cases FROM bank GROUP BY ALL) SELECT *, CASE WHEN cases >= 2 THEN 'in-area' ELSE 'adjacent' END AS tier FROM s")
def in_area_support(spark, sf):
    rows = bank(spark, sf).groupBy("cluster", "area", "pi").agg(F.count_distinct("level").alias("cases"))
    return rows.withColumn("tier", F.when(F.col("cases") >= 2, "in-area").otherwise("adjacent"))


@query("set03_except", "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'es'")
def set_except(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("source").distinct().subtract(d.filter("lang = 'es'").select("source"))


@query("set02_union_distinct", "SELECT source AS name FROM documents UNION SELECT c_mktsegment FROM customer")
def union_distinct(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("name")).union(table(spark, sf, "customer").select("c_mktsegment")).distinct()


@query("join28_session_left", f"{LOG} SELECT session_id, count(*) FILTER (WHERE NOT correct) AS misses FROM attempts GROUP BY session_id")
def session_left(spark, sf):
    log = attempts(spark, sf)
    misses = log.filter("NOT correct").groupBy("session_id").agg(F.count("*").alias("misses"))
    return log.select("session_id").distinct().join(misses, "session_id", "left").na.fill(0)


@query("join29_miss_resolution", f"{LOG}, last_ AS (SELECT user_id, question_id, arg_max(correct, (ts, id)) AS resolved FROM attempts WHERE cluster <> 'click' GROUP BY ALL) SELECT user_id, question_id, coalesce(resolved, TRUE) AS cleared FROM (SELECT DISTINCT user_id, question_id FROM attempts WHERE NOT correct) LEFT JOIN last_ USING (user_id, question_id)")
def miss_resolution(spark, sf):
    log = attempts(spark, sf)
    last = log.filter("cluster <> 'click'").groupBy("user_id", "question_id").agg(F.max_by("correct", F.struct("ts", "id")).alias("resolved"))
    return log.filter("NOT correct").select("user_id", "question_id").distinct().join(last, ["user_id", "question_id"], "left").select("user_id", "question_id", F.coalesce("resolved", F.lit(True)).alias("cleared"))


@query("join03_blueprint_weights", f"{BANK} SELECT DISTINCT area, CASE WHEN area < 'src15' THEN length(area)::DOUBLE ELSE 1.0 END AS weight FROM bank")
def blueprint_weights(spark, sf):
    areas = bank(spark, sf).select("area").distinct()
    weights = areas.filter("area < 'src15'").select("area", F.length("area").cast("double").alias("weight"))
    return areas.join(weights, "area", "left").na.fill(1.0, ["weight"])


@query("join27_duplicate_homes", f"{BANK}, h AS (SELECT pi, count(DISTINCT file) AS homes, count(DISTINCT cluster) AS clusters, min(file) AS first_home FROM bank GROUP BY pi) SELECT pi, homes, CASE WHEN homes = 1 THEN 'single' WHEN clusters = 1 THEN 'keep ' || first_home ELSE 'decide' END AS decision FROM h")
def duplicate_homes(spark, sf):
    homes = bank(spark, sf).groupBy("pi").agg(F.count_distinct("file").alias("homes"), F.count_distinct("cluster").alias("clusters"), F.min("file").alias("first_home"))
    return homes.select("pi", "homes", F.when(F.col("homes") == 1, "single").when(F.col("clusters") == 1, F.concat(F.lit("keep "), "first_home")).otherwise("decide").alias("decision"))


@query("dom16_audit_shards", f"{BANK}, s AS (SELECT id, ntile(4) OVER (PARTITION BY cluster ORDER BY id) AS shard, cluster FROM bank) SELECT cluster, shard, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM s GROUP BY ALL")
def audit_shards(spark, sf):
    rows = placed(bank(spark, sf).select("id", "cluster"), ["cluster"], [F.col("id")]).withColumn("shard", tiles(4))
    return rows.groupBy("cluster", "shard").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("dom15_crossed_design", f"{BANK} SELECT id, rater, CASE WHEN (grp + rater) % 2 = 0 THEN 'treated' ELSE 'control' END AS arm FROM (SELECT id, (row_number() OVER (PARTITION BY file ORDER BY sha256(id || ':13'), id) - 1) % 2 AS grp FROM bank), range(2) r(rater)")
def crossed_design(spark, sf):
    rows = C.shuffled_whole(bank(spark, sf).select("id", "file"), 13, ["file"]).select("id", ((F.col("place") - 1) % 2).alias("grp"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("rater"))
    return rows.select("id", "rater", F.when((F.col("grp") + F.col("rater")) % 2 == 0, "treated").otherwise("control").alias("arm"))


@query("dom13_authoring_payload", f"""{BANK}, have AS (SELECT cluster, area, pi, count(*) AS n FROM bank WHERE difficulty = 'hard' GROUP BY ALL) SELECT cluster, area, pi, slot, substr('ABCD', ((row_number() OVER (PARTITION BY cluster ORDER BY area, pi, slot) - 1) % 4 + 1)::INT, 1) AS letter
    FROM have, LATERAL (SELECT unnest(range(1, greatest(0, 4 - n) + 1)) AS slot)""")
def authoring_payload(spark, sf):
    have = bank(spark, sf).filter("difficulty = 'hard'").groupBy("cluster", "area", "pi").agg(F.count("*").alias("n")).filter("n < 4")
    rows = have.select("cluster", "area", "pi", F.explode(F.sequence(F.lit(1).cast("long"), 4 - F.col("n"))).alias("slot"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy("area", "pi", "slot")) - 1
    return rows.withColumn("letter", F.element_at(F.array(*map(F.lit, LETTERS)), place % 4 + 1))


@query("win19_stem_overlap", None)
def stem_overlap(spark, sf):
    from lumenbank.functions import text as T

    rows = bank(spark, sf).select("id", T.stems(F.col("question")).alias("q"), F.transform(B.values(F.col("options")), T.stems).alias("o"))
    rows = rows.select("id", F.transform("o", lambda x: F.size(F.array_intersect(x, F.col("q")))).alias("overlap"))
    return rows.select("id", F.when(F.array_max("overlap") > 0, F.array_position("overlap", F.array_max("overlap"))).alias("first_best"), F.array_max("overlap").alias("most"))
