"""Quality classifier: a document's own evidence joined with empirical-Bayes posteriors of its host and path."""

from __future__ import annotations

import re

import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbank.llm.common import WORD, key_of, map_rows, saved, small_side

#: Labelled documents that the document classifier, and then the weights of the site evidence, are fitted on at most.
FIT_ROWS = 8_000
#: Rows of the site table that are broadcast.
SITE_ROWS = 500_000
#: Share of good documents where labels give none.
DEFAULT_GOOD = 0.85

FEATURES = ["symbols", "capitals", "pipes", "digits", "word_length", "same_again", "variety", "ratio", "log_words", "short"]

_WORD = re.compile(WORD)


def measures(text: str | None, compressor) -> list[float]:
    """The document features of one whole text, in the order of FEATURES; zeros for a text without words."""
    import math

    text = text or ""
    words = _WORD.findall(text)
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    again = sum(map(str.__eq__, words, words[1:]))
    low = text.lower()
    capitals = sum(map(str.__ne__, text, low)) if len(low) == len(text) else sum(map(str.isupper, text))
    lengths = sum(map(len, words))
    return [
        min(sum(map(text.count, "#*$%&<>!")) / size, 0.3),
        min(capitals / size, 0.5),
        min(text.count("|") / size, 0.2),
        min(sum(map(text.count, "0123456789")) / size, 0.3),
        min(lengths / n, 20.0),
        again / n,
        math.log(len(set(words)) / n) / math.log(n + 1),
        min(len(compressor.compress(raw)) / (len(raw) + 40), 1.0),
        min(math.log(n + 1), 8.0),
        float(n < 20),
    ]


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``features``, an array; one pass over the texts, which go no further."""

    def make():
        compressor = zstandard.ZstdCompressor(level=1)
        return lambda *v: [(*v[:-1], measures(v[-1], compressor))]

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs.select(*keep, "text"), make, f"{kinds}, features array<double>")


def log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def fit_documents(rows: DataFrame) -> Column:
    """The log odds of good quality as an expression over ``features``, fitted on (features, quality)."""
    some = rows.filter(F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    frame = saved(some.select(*[F.col("features")[i].alias(f) for i, f in enumerate(FEATURES)], F.col("quality").cast("double").alias("label")))
    counts = {r.label: r.n for r in frame.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return F.lit(6.0 if counts.get(1.0) else -6.0 if counts else 2.0)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(frame)
    model = LogisticRegression(featuresCol="vector", regParam=1e-4, maxIter=60).fit(ready)
    return sum((F.lit(float(c)) * F.col("features")[i] for i, c in enumerate(model.coefficients)), F.lit(float(model.intercept)))


def site_of(docs: DataFrame, source: str, section: str) -> tuple[Column, Column]:
    """Host and path of a document's ``source``: what stands before the first slash, and the first part of the path after it.

    A source without a path has ``section`` (the language) as its path, as
    sites keep their languages apart. Nulls and missing columns are empty.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rest = F.regexp_replace(value(source), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    path = F.regexp_extract(rest, "^[^/?#]*/([^/?#]+)", 1)
    return F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.when(path != "", path).otherwise(value(section))


def site_counts(rows: DataFrame) -> DataFrame:
    """host, path, and of their labelled rows (host, path, quality) the number and the good ones: path_n, path_k, host_n, host_k.

    With them go global_good and how many documents the level above weighs in
    each share: host_weight and path_weight, by the method of moments from the
    spread of the shares beyond chance. Paths are counted once, in each task
    first, so a host with a third of all rows is no hot group; hosts are
    summed from them.
    """
    paths = saved(rows.filter("quality IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("quality").cast("double").alias("path_k")))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_k").alias("host_k"))

    def weight(n: str, k: str) -> Column:
        mean = F.sum(k) / F.sum(n)
        spread = F.sum(F.col(k) * F.col(k) / F.col(n)) / F.sum(n) - mean * mean
        chance = mean * (1 - mean) * F.count("*") / F.sum(n)
        return F.greatest(F.least(mean * (1 - mean) / F.greatest(spread - chance, F.lit(1e-6)), F.lit(1e4)), F.lit(1.0))

    # One row each, joined by broadcast.
    over_hosts = hosts.agg((F.sum("host_k") / F.sum("host_n")).alias("global_good"), weight("host_n", "host_k").alias("host_weight"))
    over_paths = paths.agg(weight("path_n", "path_k").alias("path_weight"))
    return paths.join(hosts, "host").crossJoin(F.broadcast(over_hosts)).crossJoin(F.broadcast(over_paths))


def posteriors(own: Column) -> tuple[Column, Column]:
    """host_good and path_good over :func:`site_counts`: shares of good documents, a path's drawn to its host's and that to the global one.

    ``own`` is a row's own label, which is taken out of the counts again; null for rows without one.
    """
    left = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0)) - F.when(own.isNull(), 0).otherwise(1), F.lit(0))
    good = lambda k: F.greatest(F.coalesce(F.col(k), F.lit(0.0)) - F.coalesce(own.cast("double"), F.lit(0.0)), F.lit(0.0))
    host = (good("host_k") + F.col("host_weight") * F.col("global_good")) / (left("host_n") + F.col("host_weight"))
    path = (good("path_k") + F.col("path_weight") * host) / (left("path_n") + F.col("path_weight"))
    return host, path


def fit_weights(rows: DataFrame) -> tuple[float, float, float, float]:
    """Weights of the document's odds, the host's evidence and the path's, and the constant, from labelled rows (odds, host_evidence, path_evidence, quality).

    A logistic regression; evidence that points the other way weighs nothing,
    and none counts for more than its own log odds say.
    """
    some = rows.filter(F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "odds").limit(FIT_ROWS)
    names = ["odds", "host_evidence", "path_evidence"]
    frame = saved(some.select(*names, F.col("quality").cast("double").alias("label")))
    if frame.select("label").distinct().count() < 2:
        return 1.0, 1.0, 1.0, 0.0
    model = LogisticRegression(featuresCol="vector", regParam=1e-3, maxIter=60).fit(VectorAssembler(inputCols=names, outputCol="vector").transform(frame))
    own, host, path = (float(c) for c in model.coefficients)
    return max(own, 1e-3), min(max(host, 0.0), 1.0), min(max(path, 0.0), 1.0), float(model.intercept)


def judged(docs: DataFrame, labels: DataFrame, source: str = "source", section: str = "lang") -> DataFrame:
    """:func:`classify` with the key of each row, in ``key_a`` and ``key_b``."""
    host, path = site_of(docs, source, section)
    key = key_of(docs, [c for c in ("doc_id", "text", source, section) if c in docs.columns])
    rows = docs.select(key.alias("key"), "doc_id", host.alias("host"), path.alias("path"), "text").select("key.a", "key.b", "doc_id", "host", "path", "text").withColumnsRenamed({"a": "key_a", "b": "key_b"})
    taught = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = saved(with_features(rows, ["key_a", "key_b", "doc_id", "host", "path"]).join(taught, "doc_id", "left"))
    scored = found.withColumns({"odds": fit_documents(found), "has_words": F.col("features")[FEATURES.index("log_words")] > 0}).drop("features")
    sites = saved(site_counts(scored))
    overall = sites.select("global_good", "host_weight", "path_weight").limit(1)
    # Every row has the totals; sites without a label have no counts.
    joined = scored.join(small_side(sites.drop("global_good", "host_weight", "path_weight", "host_n", "host_k"), SITE_ROWS), ["host", "path"], "left")
    joined = joined.join(small_side(saved(sites.select("host", "host_n", "host_k").distinct()), SITE_ROWS), "host", "left").join(F.broadcast(overall), how="left")
    host_good, path_good = posteriors(F.col("quality"))
    joined = joined.withColumns({"host_good": F.coalesce(host_good, F.lit(DEFAULT_GOOD)), "path_good": F.coalesce(path_good, F.lit(DEFAULT_GOOD))})
    evidence = {"host_evidence": log_odds(F.col("host_good")) - log_odds(F.coalesce("global_good", F.lit(DEFAULT_GOOD))), "path_evidence": log_odds(F.col("path_good")) - log_odds(F.col("host_good"))}
    joined = saved(joined.withColumns(evidence))
    own, of_host, of_path, constant = fit_weights(joined)
    total = F.lit(own) * F.col("odds") + F.lit(of_host) * F.col("host_evidence") + F.lit(of_path) * F.col("path_evidence") + F.lit(constant)
    sure = lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))
    score = sure(total)
    return joined.select("key_a", "key_b", "doc_id", sure(F.col("odds")).alias("document_score"), "host_good", "path_good", score.alias("score"), ((score >= 0.5) & F.col("has_words")).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, source: str = "source", section: str = "lang") -> DataFrame:
    """doc_id, document_score, host_good, path_good, score and kept of every row of ``docs``.

    ``labels`` has doc_id and quality, and teaches both levels; pass training
    labels only. The score's log odds are the document's own, and what the
    posteriors of its host and path add to the share above them, each with a
    weight that the labels give. A labelled row's own label is in neither of
    its posteriors. A null host or path is a site of its own; a text without
    words is rejected. Repeated rows stay repeated, null ids have no label,
    and extra columns are ignored. An empty table gives no rows, and without
    labels the document's score is flat.
    """
    return judged(docs, labels, source, section).drop("key_a", "key_b")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns.

    Rows go by what they hold, not by their id: of two rows with one doc_id, or
    none, each has its own verdict; rows alike in all that counts have the same.
    """
    gone = saved(judged(docs, labels).filter(~F.col("kept")).select(F.struct(F.col("key_a").alias("a"), F.col("key_b").alias("b")).alias("_key")).distinct())
    keyed = docs.withColumn("_key", key_of(docs, [c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]))
    return keyed.join(small_side(gone, 2_000_000), "_key", "left_anti").select(docs.columns)
