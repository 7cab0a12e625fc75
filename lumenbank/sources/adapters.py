"""Domain tables from the driver's tables: attempts, sessions, the catalogue of indicators and the question bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbank.functions.text import content_hash, stem_hash

# Levels and tiers in their order.
LEVELS = ["District", "Association", "ICDC"]
TIERS = ["easy", "medium", "hard"]
LETTERS = ["A", "B", "C", "D"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str, users: int = 10) -> DataFrame:
    """The answered-question log from ``events``; ids grow in log order, a null choice is a skipped question."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    value = F.col("value")
    return e.withColumn("k", k).select(
        F.col("event_id").alias("id"),
        "ts",
        (F.col("user_id") % users).alias("user_id"),
        F.col("event_type").alias("cluster"),
        F.element_at(F.array(*map(F.lit, LEVELS)), F.col("k") % 3 + 1).alias("level"),
        F.concat(F.lit("area-"), F.col("k") % 20 % 5).alias("area"),
        F.concat(F.lit("pi-"), F.col("k") % 20).alias("pi"),
        F.concat(F.lit("q-"), "k").alias("question_id"),
        F.when(value < 10, "easy").when(value < 60, "medium").otherwise("hard").alias("difficulty"),
        F.when(F.col("event_id") % 37 != 0, F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("event_id") % 4 + 1).cast("int"))).alias("chosen"),
        ((F.col("event_id") % 37 != 0) & ((F.col("event_id") * 7 + F.col("k")) % 10 < 6)).alias("correct"),
        F.floor(value * 400).alias("elapsed_ms"),
        F.concat_ws("-", F.col("user_id") % users, F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


#: The same in DuckDB, to start a WITH list.
ATTEMPTS_SQL = """
    attempts AS (
        SELECT event_id AS id, ts, user_id % 10 AS user_id, event_type AS cluster,
               CASE k % 3 WHEN 0 THEN 'District' WHEN 1 THEN 'Association' ELSE 'ICDC' END AS level,
               'area-' || (k % 20 % 5) AS area, 'pi-' || (k % 20) AS pi, 'q-' || k AS question_id,
               CASE WHEN value < 10 THEN 'easy' WHEN value < 60 THEN 'medium' ELSE 'hard' END AS difficulty,
               CASE WHEN event_id % 37 <> 0 THEN substr('ABCD', (event_id % 4 + 1)::INT, 1) END AS chosen,
               event_id % 37 <> 0 AND (event_id * 7 + k) % 10 < 6 AS correct,
               floor(value * 400)::BIGINT AS elapsed_ms,
               (user_id % 10) || '-' || strftime(ts, '%Y%m%d') AS session_id
        FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events)
    )"""


def universe(spark: SparkSession, sf_dir: str, indicators: int = 24) -> DataFrame:
    """The catalogue (cluster, area, pi): each cluster of the log with 24 indicators, of which four are never attempted."""
    clusters = table(spark, sf_dir, "events").select(F.col("event_type").alias("cluster")).distinct()
    return clusters.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(indicators - 1))).alias("n")).select(
        "cluster", F.concat(F.lit("area-"), F.col("n") % 5).alias("area"), F.concat(F.lit("pi-"), "n").alias("pi")
    )


UNIVERSE_SQL = """
    universe AS (
        SELECT cluster, 'area-' || (n % 5) AS area, 'pi-' || n AS pi
        FROM (SELECT DISTINCT event_type AS cluster FROM events), range(24) r(n)
    )"""


def blueprint(spark: SparkSession) -> DataFrame:
    """Weights of areas; an area that is absent weighs 1."""
    return spark.createDataFrame([(f"area-{i}", float(i + 1)) for i in range(4)], "area string, weight double")


BLUEPRINT_SQL = """
    blueprint AS (SELECT 'area-' || i AS area, (i + 1)::DOUBLE AS weight FROM range(4) r(i))"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from ``documents``: stem and options are slices of the text and the explanation is all the rest, so copied documents give copied questions."""
    d = table(spark, sf_dir, "documents")
    cut = lambda at, by: F.trim(F.substring("text", F.lit(at), (F.lit(10) + F.col("n_chars") % by).cast("int")))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("doc_id") % 3 + 1).cast("int"))
    section = F.when(F.col("doc_id") % 5 < 3, "sets").otherwise("pools")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("cluster"),
        level.alias("level"),
        section.alias("section"),
        F.concat_ws("-", "lang", level, section).alias("file"),
        F.col("doc_id").alias("pos"),
        F.col("source").alias("area"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id") % 6).alias("pi"),
        F.substring("text", 1, 80).alias("question"),
        F.create_map(F.lit("A"), cut(81, 7), F.lit("B"), cut(101, 11), F.lit("C"), cut(131, 13), F.lit("D"), cut(161, 5)).alias("options"),
        F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("answer"),
        F.expr("substring(text, 181)").alias("explanation"),
        F.when(F.col("n_chars") < 900, "easy").when(F.col("n_chars") < 2500, "medium").otherwise("hard").alias("difficulty"),
    )


def hashed_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).withColumns({"content_hash": content_hash(F.col("question"), F.col("options")), "stem_hash": stem_hash(F.col("question"))})


BANK_SQL = """
    bank AS (
        SELECT doc_id AS id, lang AS cluster, level, section, lang || '-' || level || '-' || section AS file, doc_id AS pos,
               source AS area, source || '-' || (doc_id % 6) AS pi, substr(text, 1, 80) AS question,
               trim(substr(text, 81, 10 + n_chars % 7), ' ') AS a, trim(substr(text, 101, 10 + n_chars % 11), ' ') AS b,
               trim(substr(text, 131, 10 + n_chars % 13), ' ') AS c, trim(substr(text, 161, 10 + n_chars % 5), ' ') AS d,
               substr('ABCD', (doc_id % 4 + 1)::INT, 1) AS answer, substr(text, 181) AS explanation,
               CASE WHEN n_chars < 900 THEN 'easy' WHEN n_chars < 2500 THEN 'medium' ELSE 'hard' END AS difficulty
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'District' WHEN 1 THEN 'Association' ELSE 'ICDC' END AS level,
                     CASE WHEN doc_id % 5 < 3 THEN 'sets' ELSE 'pools' END AS section FROM documents)
    ), hashed AS (
        SELECT *, substr(sha1(question || '‖' || a || '‖' || b || '‖' || c || '‖' || d), 1, 12) AS content_hash, substr(sha1(question), 1, 12) AS stem_hash FROM bank
    )"""
