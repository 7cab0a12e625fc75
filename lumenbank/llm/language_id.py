"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted arrays of packed n-grams.

Every n-gram of the training texts is in the models. They grow with the
texts; while they have at most CELLS probabilities they are shipped to the
tasks as arrays, and beyond that a text's n-grams are joined to the table of
n-grams instead, with the same results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenbank.llm.common import map_rows, saved

#: Characters of the longest n-gram, and bits of a character. Letters beyond 32,765 share classes.
ORDER, BITS = 4, 15
#: Different n-grams times languages up to which the models are arrays in every task.
CELLS = 24_000_000
#: One training text in so many tells how unlikely a text of the language may be, by models that have not seen it;
#: standard deviations that are allowed.
CALIBRATION, LIMIT_SD = 16, 6.0
#: Code points worked on at a time; a longer text is scored in pieces of this length.
PIECE = 1 << 20

MASK = (1 << BITS) - 1
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """The class of each code point: of letters the lower-case code point folded into BITS bits, of all else 1, a space."""
    out = np.ones(0x33480, np.int64)  # no letters from here on; the last entry stands for all of them
    for c in range(len(out) - 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0]) % (MASK - 2) + 2 if ord(low[0]) > MASK else max(ord(low[0]), 2)
    return out


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Classes of a text's characters; runs of non-letters are one space, and a space stands at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.concatenate([[1], table[np.minimum(points, len(table) - 1)], [1]])
    return kinds[np.concatenate([[True], (kinds[1:] != 1) | (kinds[:-1] != 1)])]


def packed(kinds: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each class, packed into one integer; before the text there is 0."""
    out = np.zeros(len(kinds), np.int64)
    for k in range(min(ORDER, len(kinds))):
        out[k:] |= kinds[: len(kinds) - k] << (BITS * k)
    return out


def held_back() -> F.Column:
    """Whether a training text is one of those that limits are told from."""
    return F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, ``n`` and ``rest``: counts of ORDER-grams over all of ``docs`` (lang, text), and over those that aren't held back.

    Each task merges its own before the shuffle.
    """
    schema = StructType.fromDDL("lang string, held boolean, gram long, n long")

    def run(batches):
        table, arrow = letter_table(), to_arrow_schema(schema)
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}

        def merge(lang, grams, counts):
            if lang in held:
                grams, counts = np.concatenate([held[lang][0], grams]), np.concatenate([held[lang][1], counts])
            values, at = np.unique(grams, return_inverse=True)
            held[lang] = values, np.bincount(at, counts, len(values)).astype(np.int64)

        def rows(lang):
            grams, counts = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang[0]] * len(grams)), pa.array([lang[1]] * len(grams)), pa.array(grams), pa.array(counts)], schema=arrow)

        for batch in batches:
            waiting: dict[tuple[str, bool], list[np.ndarray]] = {}
            size = 0
            for at in range(batch.num_rows):
                lang, text = (batch.column(0)[at].as_py(), batch.column(2)[at].as_py()), batch.column(1)[at].as_py()
                for start in range(0, len(text), PIECE):
                    kinds = letters(text[start : start + PIECE], table)
                    if len(kinds) > 1:
                        waiting.setdefault(lang, []).append(packed(kinds)[1:])
                        size += len(kinds)
                if size > PIECE or at == batch.num_rows - 1:
                    for k, v in waiting.items():
                        merge(k, *np.unique(np.concatenate(v), return_counts=True))
                    waiting, size = {}, 0
            for k in [k for k, v in held.items() if len(v[0]) > 4_000_000]:
                yield rows(k)
        for k in list(held):
            yield rows(k)

    found = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", held_back().alias("held")).mapInArrow(run, schema)
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("rest"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Interpolated Kneser-Ney from ORDER-gram counts: (lang, n, gram, context, p, back) with each gram's own discounted part and its context's weight.

    The highest order uses counts, lower ones the number of different
    characters before a gram. Each step is a grouped aggregate keyed by the
    gram, so it spreads over the cluster; discounts are D = n1 / (n1 + 2 n2).
    ``back`` is the weight that the context of the gram leaves to the next
    order, joined to every gram of that context.
    """
    level = counts.select("lang", F.lit(ORDER).alias("n"), "gram", F.col("n").alias("c"))
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        cut = (1 << (BITS * order)) - 1
        level = level.groupBy("lang", F.lit(order).alias("n"), F.col("gram").bitwiseAND(cut).alias("gram")).agg(F.count("*").alias("c"))
        levels.append(level)
    grams = levels[0]
    for x in levels[1:]:
        grams = grams.unionByName(x)
    grams = saved(grams.withColumn("context", F.shiftright("gram", BITS)))
    discount = grams.groupBy("lang", "n").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    discount = discount.select("lang", "n", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
    # One row for each language and order: bounded by what the models can hold at all.
    contexts = grams.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    by_context = contexts.join(F.broadcast(discount), ["lang", "n"]).select("lang", "n", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back"))
    return grams.join(by_context, ["lang", "n", "context"]).select("lang", "n", "gram", "context", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("p"), "back")


@dataclass
class LanguageModel:
    """Sorted n-grams of each order with a row of log probabilities by language, and of contexts' log weights.

    A gram's row holds the full interpolated probability of its last
    character in every language, so scoring is one binary search a character;
    characters whose longest gram no language has go to the next order.
    """

    langs: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    @classmethod
    def build(cls, rows) -> LanguageModel:
        """From pandas rows of :func:`kneser_ney`, bounded by CELLS."""
        langs = sorted(rows["lang"].unique()) if len(rows) else []
        index = {x: i for i, x in enumerate(langs)}
        grams, logs, contexts, weights = [], [], [], []
        lower = None
        for n in range(1, ORDER + 1):
            part = rows[rows["n"] == n]
            keys = np.unique(part["gram"].to_numpy(np.int64))
            heads = np.unique(keys >> BITS)
            lang = part["lang"].map(index).to_numpy(np.int64) if len(part) else np.zeros(0, np.int64)
            at, head = np.searchsorted(keys, part["gram"].to_numpy(np.int64)), np.searchsorted(heads, part["gram"].to_numpy(np.int64) >> BITS)
            own = np.zeros((len(keys), len(langs)))
            own[at, lang] = part["p"].to_numpy(float)
            left = np.ones((len(heads), len(langs)))
            left[head, lang] = part["back"].to_numpy(float)
            below = 1.0 / (MASK + 1) if n == 1 else np.exp(lower(keys & ((1 << (BITS * (n - 1))) - 1)))
            value = own + left[np.searchsorted(heads, keys >> BITS)] * below
            grams.append(keys)
            logs.append(np.log(value).astype(np.float32))
            contexts.append(heads)
            weights.append(np.log(np.maximum(left, 1e-6)).astype(np.float32))
            model = cls(langs, grams, logs, contexts, weights)
            lower = lambda g, m=model, k=n: m.score_grams(g, k)
        return model

    def score_grams(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Log probability of each gram's last character by language, from order ``n`` down."""
        if n == 0:
            return np.full((len(grams), len(self.langs)), -np.log(MASK + 1), np.float32)
        keys = self.grams[n - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        known = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
        out = self.logs[n - 1][at] if len(keys) else np.zeros((len(grams), len(self.langs)), np.float32)
        if not known.all():
            miss = grams[~known]
            heads = self.contexts[n - 1]
            h = np.minimum(np.searchsorted(heads, miss >> BITS), len(heads) - 1)
            seen = (heads[h] == miss >> BITS)[:, None]
            out[~known] = self.score_grams(miss & ((1 << (BITS * (n - 1))) - 1), n - 1) + np.where(seen, self.weights[n - 1][h], 0)
        return out

    def totals(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by language, and its number of scored characters."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        pieces: list[np.ndarray] = []
        owner: list[int] = []

        def flush():
            if pieces:
                values, at = np.unique(np.concatenate(pieces), return_inverse=True)
                scores = self.score_grams(values, ORDER)[at]
                ends = np.cumsum([0, *map(len, pieces)])[:-1]
                np.add.at(total, owner, np.add.reduceat(scores, ends, axis=0, dtype=np.float64))
                pieces.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for start in range(0, len(text), PIECE):
                kinds = letters(text[start : start + PIECE], table)
                if len(kinds) > 1:
                    pieces.append(packed(kinds)[1:])
                    owner.append(i)
                    size[i] += len(kinds) - 1
                if sum(map(len, pieces[-1:])) == PIECE or len(pieces) >= 128:
                    flush()
        flush()
        return total, size

@dataclass
class Languages:
    """Fitted models: ``table`` of :func:`kneser_ney`, its arrays while they are small (else None), and each language's usual cross-entropy."""

    langs: list[str]
    table: DataFrame
    arrays: LanguageModel | None
    mean: list[float]
    sd: list[float]

    @classmethod
    def of(cls, counts: DataFrame) -> Languages:
        table = saved(kneser_ney(counts))
        langs = sorted(r.lang for r in table.select("lang").distinct().collect())
        grams = table.select("n", "gram").distinct().count()
        arrays = LanguageModel.build(table.select("lang", "n", "gram", "p", "back").toPandas()) if grams * len(langs) <= CELLS else None
        return cls(langs, table, arrays, [0.0] * len(langs), [1.0] * len(langs))


def fit(docs: DataFrame) -> Languages:
    """Learns from (lang, text): counts over all rows.

    How unlikely a text of a language may be is told from one training text in
    CALIBRATION, chosen by a hash, under models without those texts; where a
    language has none, from its own texts. Rows without a language or a text
    teach nothing; without any, every prediction is ``und``.
    """
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = saved(gram_counts(usable))
    model = Languages.of(counts.select("lang", "gram", "n"))
    blind = Languages.of(counts.filter("rest > 0").select("lang", "gram", F.col("rest").alias("n")))
    usual: dict[str, tuple[float, float]] = {}
    alone = usable.filter(held_back())
    told = {r.lang for r in alone.select("lang").distinct().collect()} & set(blind.langs)
    # Languages without a text held back first, by the models of all texts.
    for by, rows in ((model, usable.filter(~F.col("lang").isin(*told))), (blind, alone)):
        if by.langs and (by is blind or told != set(model.langs)):
            lang = F.array_position(F.array(*map(F.lit, by.langs)), F.col("doc_id")).cast("int") - 1
            own = entropies(rows.withColumn("doc_id", F.col("lang")), by).select("doc_id", F.get("entropy", lang).alias("e"))
            for r in own.groupBy("doc_id").agg(F.avg("e").alias("mean"), F.stddev("e").alias("sd")).filter("mean IS NOT NULL").collect():
                usual[r.doc_id] = r["mean"], max(r.sd or 0.0, 0.02)
    model.mean = [usual.get(x, (float(np.log(MASK)), 1.0))[0] for x in model.langs]
    model.sd = [usual.get(x, (0.0, 1.0))[1] for x in model.langs]
    return model


def entropies(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, ``entropy`` (cross-entropy in nats a character, for each of the model's languages) and ``size`` of every row."""
    if not model.langs:
        return docs.select("doc_id", F.lit(None).cast("array<double>").alias("entropy"), F.lit(0).cast("long").alias("size"))
    return by_joins(docs, model) if model.arrays is None else by_arrays(docs, model)


def by_arrays(docs: DataFrame, model: Languages) -> DataFrame:
    schema = StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, entropy array<double>, size long")
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model.arrays)))

    def run(batches):
        table, arrow, known = letter_table(), to_arrow_schema(schema), LanguageModel(**shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                total, size = known.totals([t or "" for t in texts], table)
                rows = [(i, (-row / n).tolist() if n else None, int(n)) for i, row, n in zip(ids, total, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def by_joins(docs: DataFrame, model: Languages) -> DataFrame:
    """The same by joins: each text's n-grams with their counts, and the probability of every n-gram that occurs, order by order."""
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))

    def make():
        table = letter_table()

        def one(row, text):
            parts = [packed(kinds)[1:] for start in range(0, len(text or ""), PIECE) if len(kinds := letters(text[start : start + PIECE], table)) > 1]
            grams, n = np.unique(np.concatenate(parts), return_counts=True) if parts else ([], [])
            return list(zip([row] * len(grams), map(int, grams), map(int, n)))

        return one

    held = saved(map_rows(rows.select("row", "text"), make, "row long, gram long, n long"))
    found = held.select("gram").distinct().select("gram", F.explode(F.array(*map(F.lit, model.langs))).alias("lang"), F.lit(1.0 / (MASK + 1)).alias("p"))
    for order in range(1, ORDER + 1):
        level = model.table.filter(F.col("n") == order)
        part = F.col("gram").bitwiseAND((1 << (BITS * order)) - 1)
        found = found.withColumns({"part": part, "head": F.shiftright(part, BITS)})
        found = found.join(level.select("lang", F.col("gram").alias("part"), F.col("p").alias("own")), ["lang", "part"], "left")
        found = found.join(level.select("lang", F.col("context").alias("head"), "back").distinct(), ["lang", "head"], "left")
        found = found.select("gram", "lang", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
    logs = saved(found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("lang", F.log("p").alias("log")))).alias("logs")))
    by_text = held.join(logs, "gram").groupBy("row").agg(F.array(*[-F.sum(F.col("n") * F.col("logs")[i]["log"]) / F.sum("n") for i in range(len(model.langs))]).alias("entropy"), F.sum("n").alias("size"))
    return rows.select("row", "doc_id").join(by_text, "row", "left").select("doc_id", "entropy", F.coalesce("size", F.lit(0)).alias("size"))


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cross_entropy and rejected for every row; only ``text`` is looked at.

    A null text, or one without letters, is ``und`` with score 0. ``rejected``
    tells that the text is less likely than nearly all the language's own, or
    nearer to chance than to them. Texts are whole; repeated rows stay
    repeated; other columns are ignored; an empty table gives no rows.
    """
    found = entropies(docs, model).withColumn("best", F.array_min("entropy"))
    known = (F.col("size") > 0) & F.col("best").isNotNull()
    at = F.array_position("entropy", F.col("best")).cast("int") - 1
    of = lambda values: F.get(F.array(*map(F.lit, values)) if values else F.array().cast("array<double>"), at)
    # Characters of one text are not independent: the posterior is tempered to the root of the length.
    share = F.aggregate("entropy", F.lit(0.0), lambda s, e: s + F.exp(-(e - F.col("best")) * F.sqrt("size") * 4))
    far = of(model.mean) + F.lit(LIMIT_SD) * of(model.sd) * (1 + 8 / F.sqrt("size"))
    limit = F.least(far, (of(model.mean) + F.lit(float(np.log(MASK)))) / 2)
    name = of(model.langs) if model.langs else F.lit(None).cast("string")
    return found.select(
        "doc_id",
        F.when(known, name).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / share).otherwise(0.0).alias("score"),
        F.when(known, F.col("best")).alias("cross_entropy"),
        F.when(known, F.col("best") > limit).otherwise(True).alias("rejected"),
    )
