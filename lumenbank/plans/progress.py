"""Progress queries over the attempt log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenbank.operators import mastery as M
from lumenbank.sources.adapters import ATTEMPTS_SQL, BLUEPRINT_SQL, UNIVERSE_SQL, attempts, blueprint, universe

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df, *names, places: int = 6):
    return df.withColumns({n: F.round(n, places) for n in names})


RANKED_SQL = """
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, cluster, area, pi ORDER BY ts DESC, id) - 1 AS recency,
               CASE difficulty WHEN 'easy' THEN 0.7 WHEN 'medium' THEN 1.0 ELSE 1.3 END AS tier_weight
        FROM attempts
    ), weighted AS (SELECT *, tier_weight * pow(0.9::DOUBLE, recency) AS w FROM ranked
    ), stats AS (
        SELECT user_id, cluster, area, pi, (1.5 + sum(w * correct::INT)) / (3.0 + sum(w)) AS mastery, least(1.0, sum(w) / 4.0) AS coverage,
               sum(w) AS evidence, count(*) AS n, sum(w) < 3.0 AS provisional, max(ts) AS last_ts
        FROM weighted GROUP BY ALL
    )"""
WHOLE_SQL = f"""
    {UNIVERSE_SQL}, whole AS (
        SELECT user_id, cluster, area, pi, coalesce(mastery, 0) AS mastery, coalesce(coverage, 0) AS coverage, coalesce(evidence, 0) AS evidence,
               coalesce(n, 0) AS n, coalesce(provisional, TRUE) AS provisional, last_ts, n IS NOT NULL AS seen
        FROM (SELECT DISTINCT user_id, cluster, area, pi FROM (SELECT user_id, u.* FROM (SELECT DISTINCT user_id FROM attempts), universe u UNION ALL SELECT user_id, cluster, area, pi FROM stats))
        LEFT JOIN stats USING (user_id, cluster, area, pi)
    ), areas AS (
        SELECT user_id, cluster, area, avg(coverage * mastery) AS mastery, avg(coverage) AS coverage, count(*) FILTER (WHERE seen) AS seen, count(*) AS pis
        FROM whole GROUP BY ALL
    )"""
READY_SQL = f"""
    {BLUEPRINT_SQL}, ready AS (
        SELECT user_id, cluster, sum(coalesce(weight, 1) * mastery) / sum(coalesce(weight, 1)) AS readiness
        FROM areas LEFT JOIN blueprint USING (area) GROUP BY ALL
    )"""
LOG = f"WITH {ATTEMPTS_SQL}"
STATS = f"{LOG}, {RANKED_SQL}"
WHOLE = f"{STATS}, {WHOLE_SQL}"


@query("agg02_pi_stats", f"{STATS} SELECT user_id, cluster, area, pi, round(mastery, 6) AS mastery, round(coverage, 6) AS coverage, round(evidence, 6) AS evidence, n, provisional, last_ts FROM stats")
def pi_stats(spark, sf):
    return rounded(M.pi_stats(attempts(spark, sf)), "mastery", "coverage", "evidence")


@query("win01_recency_rank", f"{STATS} SELECT id, user_id, cluster, area, pi, recency FROM ranked")
def recency(spark, sf):
    return M.ranked(attempts(spark, sf)).select("id", "user_id", "cluster", "area", "pi", "recency")


@query("flt02_scope_filter", f"{LOG} SELECT id, user_id, correct FROM attempts WHERE cluster = 'click' AND level = 'ICDC'")
def scope(spark, sf):
    return M.scoped(attempts(spark, sf), "click", "ICDC").select("id", "user_id", "correct")


@query("join01_universe_outer", f"{WHOLE} SELECT user_id, cluster, area, pi, round(mastery, 6) AS mastery, round(coverage, 6) AS coverage, round(evidence, 6) AS evidence, n, provisional, last_ts, seen FROM whole")
def universe_outer(spark, sf):
    return rounded(M.universe_stats(attempts(spark, sf), universe(spark, sf)), "mastery", "coverage", "evidence")


def _areas(spark, sf):
    return M.area_mastery(M.universe_stats(attempts(spark, sf), universe(spark, sf)))


@query("agg03_area_mastery", f"{WHOLE} SELECT user_id, cluster, area, round(mastery, 6) AS mastery, round(coverage, 6) AS coverage, seen, pis FROM areas")
def area_mastery(spark, sf):
    return rounded(_areas(spark, sf), "mastery", "coverage")


@query("agg05_readiness", f"{WHOLE}, {READY_SQL} SELECT user_id, cluster, round(readiness, 6) AS readiness FROM ready")
def readiness(spark, sf):
    return rounded(M.readiness(_areas(spark, sf), blueprint(spark)), "readiness")


@query("agg06_readiness_all", f"""{WHOLE}, {READY_SQL}, tries AS (SELECT user_id, cluster, count(*) AS tries FROM attempts GROUP BY ALL)
    SELECT user_id, round(sum(tries * readiness) / sum(tries), 6) AS readiness FROM ready JOIN tries USING (user_id, cluster) GROUP BY ALL""")
def readiness_all(spark, sf):
    return rounded(M.readiness_all(M.readiness(_areas(spark, sf), blueprint(spark)), attempts(spark, sf)), "readiness")


@query("agg14_areas_covered", f"{WHOLE} SELECT user_id, round(sum(coverage) / count(*), 6) AS covered FROM areas GROUP BY ALL")
def areas_covered(spark, sf):
    return rounded(_areas(spark, sf).groupBy("user_id").agg((F.sum("coverage") / F.count("*")).alias("covered")), "covered")


@query("win02_weakest_pis", f"""{WHOLE} SELECT user_id, cluster, area, pi, round(weakness, 6) AS weakness, place FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weakness, 9) DESC, last_ts NULLS FIRST, cluster, area, pi) AS place
        FROM (SELECT *, CASE WHEN NOT seen THEN 0.55 ELSE (1 - mastery) * CASE WHEN provisional THEN 0.7 ELSE 1.0 END END AS weakness FROM whole)) WHERE place <= 12""")
def weakest(spark, sf):
    found = M.weakest(M.universe_stats(attempts(spark, sf), universe(spark, sf)))
    return rounded(found.select("user_id", "cluster", "area", "pi", "weakness", "place"), "weakness")


@query("agg04_area_pi_stats", f"{WHOLE} SELECT user_id, cluster, area, pi, round(mastery, 6) AS mastery, row_number() OVER (PARTITION BY user_id, cluster, area ORDER BY round(mastery, 9), pi) AS place FROM whole")
def area_pi_stats(spark, sf):
    stats = M.universe_stats(attempts(spark, sf), universe(spark, sf))
    place = F.row_number().over(M.W.partitionBy("user_id", "cluster", "area").orderBy(F.round("mastery", 9), "pi"))
    return rounded(stats.withColumn("place", place).select("user_id", "cluster", "area", "pi", "mastery", "place"), "mastery")


@query("agg07_accuracy", f"""{LOG} SELECT user_id, cluster, count(chosen) AS answered, count(*) FILTER (WHERE correct) AS correct,
    round(coalesce(count(*) FILTER (WHERE correct) / nullif(count(chosen), 0)::DOUBLE, 0), 6) AS accuracy FROM attempts GROUP BY ALL""")
def accuracy(spark, sf):
    return rounded(M.accuracy(attempts(spark, sf), ["user_id", "cluster"]), "accuracy")


@query("agg08_accuracy_by_tier", f"""{LOG}, newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) AS place FROM attempts)
    SELECT user_id, """ + ", ".join(f"round(CASE WHEN count(*) FILTER (WHERE difficulty = '{t}') >= 3 THEN avg(correct::INT) FILTER (WHERE difficulty = '{t}') ELSE avg(correct::INT) END, 6) AS {t}" for t in M.WEIGHTS) + " FROM newest WHERE place <= 80 GROUP BY ALL")
def accuracy_by_tier(spark, sf):
    return rounded(M.accuracy_by_tier(attempts(spark, sf)), *M.WEIGHTS)


THRESHOLDS_SQL = """limits AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE difficulty = 'easy') >= 8 THEN median(elapsed_ms) FILTER (WHERE difficulty = 'easy') ELSE 12000.0 END AS easy_ms,
    CASE WHEN count(*) FILTER (WHERE difficulty = 'hard') >= 8 THEN median(elapsed_ms) FILTER (WHERE difficulty = 'hard') ELSE 45000.0 END AS hard_ms FROM attempts GROUP BY ALL)"""


@query("agg09_thresholds", f"{LOG}, {THRESHOLDS_SQL} SELECT * FROM limits")
def thresholds(spark, sf):
    return M.thresholds(attempts(spark, sf))


ERRORS_SQL = f"""{LOG}, {THRESHOLDS_SQL}, misses AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY ts DESC, id DESC) AS back FROM attempts WHERE NOT correct
    ), newest AS (SELECT user_id, question_id, max(ts) AS last_ts, arg_max(correct, (ts, id)) AS resolved, count(*) FILTER (WHERE NOT correct) AS misses FROM attempts GROUP BY ALL
    ), errors AS (
        SELECT user_id, question_id, n.misses, m.ts, cluster, area, pi, difficulty, chosen, elapsed_ms, last_ts, resolved,
               CASE WHEN chosen IS NULL THEN 'missed' WHEN difficulty = 'easy' AND elapsed_ms < easy_ms THEN 'careless' WHEN difficulty = 'hard' AND elapsed_ms > hard_ms THEN 'slow' ELSE 'missed' END AS pattern
        FROM misses m JOIN newest n USING (user_id, question_id) JOIN limits USING (user_id) WHERE back = 1
    )"""


@query("agg10_error_log", f"{ERRORS_SQL} SELECT * FROM errors")
def error_log(spark, sf):
    return M.error_log(attempts(spark, sf))


@query("agg12_errors_by_pi", f"{ERRORS_SQL} SELECT user_id, cluster, area, pi, count(*) AS questions, sum(misses)::BIGINT AS misses, count(*) FILTER (WHERE NOT resolved) AS open FROM errors GROUP BY ALL")
def errors_by_pi(spark, sf):
    return M.error_log(attempts(spark, sf)).groupBy("user_id", "cluster", "area", "pi").agg(F.count("*").alias("questions"), F.sum("misses").alias("misses"), F.count_if(~F.col("resolved")).alias("open"))


@query("agg12_errors_by_pattern", f"{ERRORS_SQL} SELECT user_id, pattern, count(*) AS questions, string_agg(question_id, ',' ORDER BY question_id) AS ids FROM errors GROUP BY ALL")
def errors_by_pattern(spark, sf):
    return M.error_log(attempts(spark, sf)).groupBy("user_id", "pattern").agg(F.count("*").alias("questions"), F.array_join(F.array_sort(F.collect_list("question_id")), ",").alias("ids"))


SESSIONS_SQL = """sessions AS (SELECT session_id, user_id, min(ts) AS ts, count(*) AS total, count(chosen) AS answered, count(*) FILTER (WHERE correct) AS correct, sum(elapsed_ms)::BIGINT AS elapsed_ms,
    CASE WHEN user_id % 11 <> 5 THEN max(ts) END AS ended_ts FROM attempts GROUP BY session_id, user_id)"""


@query("agg43_session_rollup", f"{LOG}, {SESSIONS_SQL} SELECT * FROM sessions")
def session_rollup(spark, sf):
    return M.sessions(attempts(spark, sf))


@query("agg13_session_mix", f"""{LOG}, {SESSIONS_SQL}
    SELECT s.session_id, s.user_id, count(e.id) FILTER (WHERE difficulty = 'easy') AS easy, count(e.id) FILTER (WHERE difficulty = 'medium') AS medium, count(e.id) FILTER (WHERE difficulty = 'hard') AS hard, count(e.id) AS total
    FROM sessions s LEFT JOIN attempts e USING (session_id) GROUP BY ALL""")
def session_mix(spark, sf):
    log = attempts(spark, sf)
    return M.session_mix(M.sessions(log).select("session_id", "user_id"), log)


@query("win04_trajectory", f"""{LOG}, {UNIVERSE_SQL}, {BLUEPRINT_SQL}, known AS (
        SELECT a.*, CASE difficulty WHEN 'easy' THEN 0.7 WHEN 'medium' THEN 1.0 ELSE 1.3 END AS tw FROM attempts a SEMI JOIN universe USING (cluster, area, pi)
    ), pairs AS (
        SELECT t.user_id, t.cluster, t.id AS point, a.area, a.pi, a.tw, a.correct, row_number() OVER (PARTITION BY t.id, a.area, a.pi ORDER BY a.ts DESC, a.id) - 1 AS recency
        FROM known t JOIN known a ON t.user_id = a.user_id AND t.cluster = a.cluster AND (a.ts < t.ts OR a.ts = t.ts AND a.id >= t.id)
    ), shares AS (
        SELECT point, area, pi, least(1.0, sum(tw * pow(0.9::DOUBLE, recency)) / 4) * (1.5 + sum(tw * pow(0.9::DOUBLE, recency) * correct::INT)) / (3 + sum(tw * pow(0.9::DOUBLE, recency))) AS share FROM pairs GROUP BY ALL
    ), sizes AS (SELECT cluster, area, count(*) AS pis, coalesce(any_value(weight), 1) AS weight FROM universe LEFT JOIN blueprint USING (area) GROUP BY ALL
    ), totals AS (SELECT cluster, sum(weight) AS all_weight FROM sizes GROUP BY ALL)
    SELECT k.user_id, cluster, k.id, k.ts, round(sum(share / pis * weight / all_weight) + 1e-9, 6) AS readiness
    FROM shares JOIN known k ON k.id = point JOIN sizes USING (cluster) JOIN totals USING (cluster) WHERE shares.area = sizes.area GROUP BY ALL""")
def trajectory(spark, sf):
    points = M.trajectory(attempts(spark, sf), universe(spark, sf), blueprint(spark))
    # Sums of few terms end on the digit that is rounded; a nudge settles which way in both engines.
    return points.withColumn("readiness", F.round(F.col("readiness") + 1e-9, 6))


@query("win05_day_best", f"""{LOG}, points AS (SELECT user_id, cluster, id, ts, elapsed_ms / 1000.0 AS readiness FROM attempts
    ), p AS (SELECT *, count(*) OVER (PARTITION BY user_id, cluster) > 14 AS many, row_number() OVER (PARTITION BY user_id, cluster, ts::DATE ORDER BY round(readiness, 9) DESC, ts DESC, id DESC) AS place FROM points)
    SELECT user_id, cluster, id, ts, round(readiness, 6) AS readiness FROM p WHERE NOT many OR place = 1""")
def day_best(spark, sf):
    points = attempts(spark, sf).select("user_id", "cluster", "id", "ts", (F.col("elapsed_ms") / 1000.0).alias("readiness"))
    return rounded(M.day_best(points), "readiness")
