"""Runs of published words that stand in source documents, while one document still holds the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators.bank import ngram_matches


def own_grams(catalogue: DataFrame, n: int) -> DataFrame:
    """(gram): the n-grams of the catalogue's own texts, which are published by design."""
    words = catalogue.select(F.split(T.plain_norm(F.col("text")), " ").alias("w"))
    return words.select(F.explode(T.word_ngrams(F.col("w"), n)).alias("g")).select("g.gram").distinct()


def matches(published: DataFrame, corpus: DataFrame, catalogue: DataFrame, n: int = 8, most_docs: int = 6) -> DataFrame:
    """(unit, start, gram, doc): published n-grams of the corpus that are neither the catalogue's own nor in ``most_docs`` or more documents.

    They meet by hash; then each match is read again in its document and kept only if the words are the same.
    """
    found = ngram_matches(published, corpus, n, most_docs).join(own_grams(catalogue, n), "gram", "left_anti")
    flat = corpus.select("doc", F.concat(F.lit(" "), T.plain_norm(F.col("text")), F.lit(" ")).alias("flat"))
    same = F.contains("flat", F.concat(F.lit(" "), "gram", F.lit(" ")))
    return found.join(flat, "doc").filter(same).select("unit", "start", "gram", "doc")


def narrowing_runs(found: DataFrame, n: int) -> DataFrame:
    """(unit, start, words, docs): a unit's runs of neighbouring matches, each with the documents that hold all of it.

    From the first match on, a run takes the next start while some document
    has all its n-grams; its documents narrow along the way. Where none is
    left, the next run begins with that match and all its documents. Matches of
    one unit are no more than its words by the documents an n-gram may have.
    """
    hits = found.groupBy("unit", "start").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    hits = hits.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("start", "docs"))).alias("hits"))
    kind = found.schema["doc"].dataType.simpleString()
    run = f"struct<start:int,last:int,docs:array<{kind}>>"
    first = F.expr(f"cast(named_struct('done', array(), 'now', null) as struct<done:array<{run}>,now:{run}>)")

    def step(acc, hit):
        now = acc["now"]
        shared = F.array_intersect(now["docs"], hit["docs"])
        goes_on = now.isNotNull() & (hit["start"] == now["last"] + 1) & (F.size(shared) > 0)
        longer = F.struct(now["start"].alias("start"), hit["start"].alias("last"), shared.alias("docs"))
        fresh = F.struct(hit["start"].alias("start"), hit["start"].alias("last"), hit["docs"].alias("docs"))
        closed = F.when(goes_on | now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(closed.alias("done"), F.when(goes_on, longer).otherwise(fresh).alias("now"))

    runs = hits.select("unit", F.explode(F.aggregate("hits", first, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))).alias("r"))
    return runs.select("unit", "r.start", (F.col("r.last") - F.col("r.start") + n).alias("words"), "r.docs")


def report(runs: DataFrame, fail: int) -> DataFrame:
    """(unit, words, start, docs, failed): each unit's longest run, the first of equals."""
    best = runs.groupBy("unit").agg(F.min(F.struct((-F.col("words")).alias("less"), "start", "words", "docs")).alias("b"))
    return best.select("unit", "b.words", "b.start", "b.docs", (F.col("b.words") >= fail).alias("failed"))
