"""Toxicity: held-out recall and clean texts, single and hidden insults, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lumenbank.llm import toxicity
from lumenbank.llm.common import table, training_half

SF = "/root/testdata/sf0.1"
INSULTS = ("idiot", "moron", "stupid", "worthless", "scum", "clown")


@pytest.fixture(scope="module")
def model(spark):
    learn = training_half(F.col("doc_id"))
    return toxicity.fit(table(spark, SF, "documents").filter(learn), table(spark, SF, "labels").filter(learn))


def scores(spark, model, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.score for r in toxicity.score(rows, model).orderBy("doc_id").collect()]


def test_held_out(spark, model):
    held = ~training_half(F.col("doc_id"))
    found = toxicity.score(table(spark, SF, "documents").filter(held), model).join(table(spark, SF, "labels"), "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("p"), F.count("*").alias("n")).collect()
    got = {r.toxic: (r.p, r.n) for r in found}

    assert got[1][0] >= 0.9 * got[1][1]  # about one in twenty of the labelled texts holds no insult
    assert got[0][0] <= 0.01 * got[0][1]


def test_single_insults(spark, model):
    plain = scores(spark, model, [f"The weather of the morning, you {w}." for w in INSULTS])
    spaced = scores(spark, model, ["The weather " + " ".join(w) + " of the morning." for w in INSULTS])
    dotted = scores(spark, model, [f"The weather {w[:2]}-{w[2:]} of the morning." for w in INSULTS])
    assert min(plain + spaced + dotted) >= 0.7


def test_inserted_characters(spark, model):
    r = random.Random(4)
    hidden = [w[:i] + r.choice("xkqvz") + w[i:] for w in INSULTS for i in (2, 3)]
    got = scores(spark, model, [f"The weather of the morning, you {w}." for w in hidden])

    assert sum(s >= 0.7 for s in got) >= 0.6 * len(got)
    assert min(scores(spark, model, [f"You {a} and {b}. Such a {b}! It is {a}." for a, b in zip(hidden, hidden[1:])])) >= 0.7


def test_clean_sentences(spark, model):
    some = ["The quick brown fox jumps over the lazy dog.", "Der Himmel ist heute sehr blau.", "Les enfants jouent dans le jardin.", "", None, "12 34 ...", "El perro duerme."]
    assert max(scores(spark, model, some)) < 0.7


def test_long_text_is_whole(spark, model):
    long = "the thing of that and for it. " * 60_000
    assert scores(spark, model, [long, long + "You idiot and moron."])[0] < 0.7 <= scores(spark, model, [long, long + "You idiot and moron."])[1]


def test_rising_share():
    at, share = toxicity.rising_share(__import__("numpy").array([0.0, 1.0, 2.0, 3.0]), __import__("numpy").array([0.0, 1.0, 0.0, 1.0]))
    assert list(at) == [0.0, 1.0, 3.0]
    assert list(share) == pytest.approx([0.25, 0.5, 0.75])
