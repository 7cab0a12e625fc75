"""The corpus queries: thin uses of the operators over whole tables, for ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbank.llm import alignment, byte_bpe, chat, decontaminate, html_text, language_id, merkle, quality_model, quality_rules, simhash, text_tree, toxicity, url_filter
from lumenbank.llm.common import table, training_half


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(turns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(training_half(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (~training_half(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = training_half(F.col("doc_id"))
    found = toxicity.score(docs, toxicity.fit(docs.filter(learn), labels.filter(learn)))
    return found.select("doc_id", (~learn).alias("held_out"), "score", "predicted", "top_margin")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("signature")).alias("fingerprint"), "component_id")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = training_half(F.col("doc_id"))
    found = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(learn))
    return found.select("doc_id", (~learn).alias("held_out"), "document_score", "host_good", "path_good", "score", "kept")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.UrlModel.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tree.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_quality_model": op7_quality_model,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_document_tree": op13_document_tree,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), s AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was,
                   len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE)\])')) AS controls
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(text) + controls + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE length(role) + 18 END)::BIGINT AS formatted_chars,
               sum(CASE WHEN was IS NULL AND role IN ('system', 'user') OR was IN ('system', 'assistant') AND role = 'user' OR was = 'user' AND role = 'assistant' THEN 0 ELSE 1 END)::BIGINT AS invalid_turns
        FROM s GROUP BY conv_id
    """,
    "op9_decontaminate": r"""
        WITH d AS (
            SELECT doc_id AS id, row_number() OVER () AS row, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
        ), i AS (
            SELECT item_id AS id, row_number() OVER () AS row, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
        ), l AS (
            SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0
        ), ds AS (
            SELECT DISTINCT id, row, unnest(CASE WHEN len(w) >= n THEN list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')) ELSE [] END) AS s FROM d, l
        ), si AS (
            SELECT DISTINCT id, row, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i
        ), n AS (SELECT row, count(*) AS n_item FROM si GROUP BY row)
        SELECT ds.id AS doc_id, si.id AS item_id, n.n_item AS n_item, count(*) AS n_shared, count(*)::DOUBLE / n.n_item AS containment
        FROM ds JOIN si USING (s) JOIN n ON n.row = si.row
        GROUP BY ds.id, ds.row, si.id, si.row, n.n_item
        HAVING count(*) >= ceil(0.8 * n.n_item)
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE leaves AS (
            SELECT row_number() OVER () AS row, doc_id, source,
                   sha256(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source::VARCHAR)::VARCHAR || ':' || source::VARCHAR, '-') || coalesce(strlen(lang::VARCHAR)::VARCHAR || ':' || lang::VARCHAR, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || coalesce(strlen(text::VARCHAR)::VARCHAR || ':' || text::VARCHAR, '-')) AS leaf,
                   sha256(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source::VARCHAR)::VARCHAR || ':' || source::VARCHAR, '-') || coalesce(strlen(lang::VARCHAR)::VARCHAR || ':' || lang::VARCHAR, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || coalesce(strlen(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR, '-')) AS changed,
                   xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 5 = 0 AS chosen
            FROM documents
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaves
        ), up AS (
            SELECT source, 0 AS level, place, size, leaf AS digest FROM placed
            UNION ALL
            SELECT source, level + 1, place // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE size > 1 GROUP BY source, level, place // 16, size
        ), subroots AS (
            SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1
        ), top AS (
            SELECT 0 AS level, place, size, subroot AS digest FROM subroots
            UNION ALL
            SELECT level + 1, place // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE size > 1 GROUP BY level, place // 16, size
        ), root AS (
            SELECT digest AS root FROM top WHERE size = 1
        ), steps AS (
            SELECT p.row, u.level, u.place AS place, u.digest, u.place = p.place // (16 ** u.level)::BIGINT AS own
            FROM placed p JOIN up u ON u.source IS NOT DISTINCT FROM p.source AND u.size > 1 AND u.place // 16 = (p.place // (16 ** u.level)::BIGINT) // 16
            UNION ALL
            SELECT p.row, 1000 + t.level, t.place, t.digest, t.place = s.place // (16 ** t.level)::BIGINT
            FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN top t ON t.size > 1 AND t.place // 16 = (s.place // (16 ** t.level)::BIGINT) // 16
        ), beside AS (
            SELECT row, level, dense_rank() OVER (PARTITION BY row ORDER BY level) AS step, place, digest, own FROM steps
        ), runs AS (
            SELECT row, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT own), '') AS siblings,
                   coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT own AND place < mine), '') AS lefts,
                   coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT own AND place > mine), '') AS rights
            FROM (SELECT *, max(place) FILTER (WHERE own) OVER (PARTITION BY row, step) AS mine FROM beside) GROUP BY row, step
        ), folded AS (
            SELECT row, 0::BIGINT AS step, CASE WHEN chosen THEN changed ELSE leaf END AS digest FROM leaves
            UNION ALL
            SELECT f.row, r.step, sha256(r.lefts || f.digest || r.rights) FROM folded f JOIN runs r ON r.row = f.row AND r.step = f.step + 1
        ), ends AS (
            SELECT row, arg_max(digest, step) AS folded_root FROM folded GROUP BY row
        ), proofs AS (
            SELECT row, string_agg(siblings, '' ORDER BY step) AS proof FROM runs GROUP BY row
        )
        SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
        FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends e ON e.row = p.row LEFT JOIN proofs q ON q.row = p.row CROSS JOIN root
    """,
}
