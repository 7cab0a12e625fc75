"""Toxicity: an SVM on a gap-weighted subsequence kernel with Nyström landmarks, learned from labelled sentences as bags of words.

A sentence is as toxic as its worst word: its margin is the largest of its
words'. Sentences have the label of their document, and most sentences of a
toxic document hold no insult, so the machine learns which words of them do:
it starts with all words of toxic sentences as insults, and in each later
round only those keep the label that it finds to be on that side itself
(mi-SVM). Words that clean sentences have as often end on the other side.
"""

from __future__ import annotations

import re
from collections import Counter
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenbank.llm.common import map_rows, saved

#: Letters of a subsequence lie within SPAN characters; each one costs a factor DECAY.
SPAN, DECAY, DIMENSIONS = 6, 0.7, 1 << 16
#: The bound of what a fit learns from: labelled documents of each class, and of their sentences toxic and clean ones.
FIT_DOCS, TOXIC_SENTENCES, CLEAN_SENTENCES = 4_000, 10_000, 20_000
#: Landmarks of the kernel, cost of a margin below one in the first round and later, and rounds.
LANDMARKS, COSTS, ROUNDS = 480, (0.2, 10.0), 4
#: The most that the margin of a disguised insult is raised to.
HIDDEN_GOAL = 3.0
#: Words of a sentence; a longer one counts as several. Letters of a word that is learned from.
WORDS, LETTERS = 40, 64
#: A text is judged by so many of its largest sentence margins, each against what toxic and clean texts have there.
RANKS = (1, 2, 3, 5)
#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000

_NOT_LETTER = re.compile(r"[\W\d_]+")
_PAIRS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]


def units(text: str | None) -> list[str]:
    """Lower-cased tokens, and each run of four or more single-character tokens as one, so that spaced words count too."""
    tokens = (text or "").lower().split()
    out, run = tokens, []
    joined = []
    for t in tokens:
        if len(t) == 1:
            run.append(t)
            continue
        if len(run) > 3:
            joined.append("".join(run))
        run = []
    if len(run) > 3:
        joined.append("".join(run))
    return out + joined if joined else out


_END = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """The different sentences of a whole text as :func:`units`, at most WORDS of them in each."""
    found = dict.fromkeys(tuple(some[k : k + WORDS]) for s in _END.split(text or "") if (some := units(s)) for k in range(0, len(some), WORDS))
    return list(found)


def kernel_map(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the kernel's feature space: row numbers, hashed subsequences, and weights of unit length.

    Only letters of a word count, with a mark at both ends. A feature is three
    characters in order within SPAN places, weighing DECAY to the places they
    span, so an inserted or dropped character costs weight and no more.
    """
    letters = [f"^{_NOT_LETTER.sub('', w)}$" for w in words]
    sizes = np.array([len(w) for w in letters], np.int64)
    points = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from here to the word's end
    rows, keys, weights = [], [], []
    with np.errstate(over="ignore"):
        for j, k in _PAIRS:
            at = np.flatnonzero(left > k)
            mixed = (points[at] * np.uint64(0x9E3779B97F4A7C15) + points[at + j]) * np.uint64(0xBF58476D1CE4E5B9) + points[at + k]
            rows.append(owner[at])
            keys.append(((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.int64))
            weights.append(np.full(len(at), DECAY ** (k + 1)))
    rows, keys, weights = np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)
    # The same subsequence of one word adds up before the norm is taken.
    both, at = np.unique(rows * DIMENSIONS + keys, return_inverse=True)
    total = np.bincount(at, weights, len(both))
    rows, keys = both // DIMENSIONS, both % DIMENSIONS
    norm = np.sqrt(np.bincount(rows, total**2, len(words)))
    return rows, keys, total / np.maximum(norm[rows], 1e-12)


def dense(words: list[str]) -> np.ndarray:
    """The feature space's rows of words, as columns."""
    rows, keys, weights = kernel_map(words)
    out = np.zeros((DIMENSIONS, len(words)), np.float32)
    out[keys, rows] = weights
    return out


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values between words and the landmarks of :func:`dense`."""
    out = np.zeros((len(words), landmarks.shape[1]), np.float32)
    for at in range(0, len(words), 1_024):
        rows, keys, weights = kernel_map(words[at : at + 1_024])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for block in range(0, len(starts), 128):
            a, b = starts[block], starts[block + 128] if block + 128 < len(starts) else len(rows)
            values = landmarks[keys[a:b]] * weights[a:b, None].astype(np.float32)
            out[at + rows[starts[block : block + 128]]] = np.add.reduceat(values, starts[block : block + 128] - a, axis=0)
    return out


def fit_svm(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], cost: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by Newton steps, in blocks of rows.

    A part has a matrix, which of its rows count, the margin that each should reach, with its sign, and their weights.
    """
    n = parts[0][0].shape[1]
    w, ridge = np.zeros(n + 1), np.eye(n + 1)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        curve, slope = ridge.copy(), np.zeros(n + 1)
        for x, which, goals, weights in parts:
            for k in range(0, len(which), 8_192):
                z, goal = x[which[k : k + 8_192]].astype(np.float32), goals[k : k + 8_192]
                active = np.sign(goal) * (z @ w[:-1].astype(np.float32) + w[-1]) < np.abs(goal)
                z = np.hstack([z[active], np.ones((int(active.sum()), 1), np.float32)])
                za = z * (2 * cost * weights[k : k + 8_192][active, None]).astype(np.float32)
                curve += za.T @ z
                slope += za.T @ goal[active].astype(np.float32)
        step = np.linalg.solve(curve, slope)
        if np.abs(step - w).max() < 1e-4:
            break
        w = step
    return w[:-1], float(w[-1])


class ToxicModel:
    """``direction`` and ``bias`` give a word's margin; ``curves`` turn each rank's margin into a share of toxic texts."""

    def __init__(self, direction: np.ndarray, bias: float, curves: list[tuple[np.ndarray, np.ndarray]]):
        self.direction, self.bias, self.curves = direction, bias, curves

    def margins(self, words: list[str]) -> np.ndarray:
        """The sum over landmarks of coefficient times kernel, folded into one vector of the feature space beforehand."""
        rows, keys, weights = kernel_map(words)
        found = np.bincount(rows, weights * self.direction[keys], len(words)) + self.bias
        empty = np.bincount(rows, minlength=len(words)) == 0
        return np.where(empty, -2.0, np.clip(found, -2.0, 4.0))


def top_margins(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and the largest sentence margins of each whole text at RANKS; -2 where a text has fewer sentences."""
    schema = StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, margins array<double>")
    shared = docs.sparkSession.sparkContext.broadcast((model.direction, model.bias))

    def run(batches):
        known, arrow = ToxicModel(*shared.value, []), to_arrow_schema(schema)
        margin: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 128).columns)
                split = [sentences(t) for t in texts]
                if len(margin) > REMEMBERED:
                    margin.clear()
                new = list({w for some in split for s in some for w in s}.difference(margin))
                for k in range(0, len(new), 16_384):
                    margin.update(zip(new[k : k + 16_384], known.margins(new[k : k + 16_384]).tolist()))
                tops = [nlargest(RANKS[-1], (max(map(margin.__getitem__, s)) for s in some)) for some in split]
                rows = [(i, [t[k - 1] if k <= len(t) else -2.0 for k in RANKS]) for i, t in zip(ids, tops)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most FIT_DOCS labelled documents of each class (doc_id, text, toxic), those with the least hash of their id."""
    rows = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    some = [rows.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS) for c in (0, 1)]
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # 2 x FIT_DOCS ids at most


def labelled_sentences(sample: DataFrame) -> dict[int, tuple[list[list[str]], float]]:
    """For each class its sentences and how many sentences of the sample each stands for; those with the least hash if there are more than the bound.

    A sentence that several documents share is one.
    """
    found = map_rows(sample.select("toxic", "text"), lambda: lambda y, t: [(y, " ".join(w for w in s if len(w) <= LETTERS)) for s in sentences(t)], "toxic int, sentence string")
    found = saved(found.distinct())
    sizes = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    out = {}
    for label, most in ((1, TOXIC_SENTENCES), (0, CLEAN_SENTENCES)):
        rows = found.filter(F.col("toxic") == label).select("sentence").orderBy(F.xxhash64("sentence"), "sentence").limit(most).collect()
        out[label] = [r.sentence.split() for r in rows if r.sentence], max(1.0, sizes.get(label, 0) / max(len(rows), 1))
    return out


def disguised(word: str, some: np.random.Generator) -> list[str]:
    """The word as it may hide: with a letter put in, with another, and with one of its own twice."""
    at = some.integers(1, max(2, len(word)), 3)
    letters = [chr(97 + k) for k in some.integers(0, 26, 2)]
    return [word[:i] + c + word[i:] for i, c in zip(at, [*letters, word[at[2] - 1 : at[2]]])]


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learns from the sentences of a bounded sample of labelled documents; without both classes every score is 0.

    Landmarks are words that toxic sentences have more often than clean ones,
    and common clean words; they only span the space, the labels come from the
    sentences. Words found insulting also count as :func:`disguised`.
    """
    sample = saved(labelled_sample(docs, labels))
    flat = ToxicModel(np.zeros(DIMENSIONS, np.float32), -1.0, [(np.array([-2.0]), np.array([0.0]))] * len(RANKS))
    found = labelled_sentences(sample)
    (toxic, toxic_weight), (clean, clean_weight) = found[1], found[0]
    if not toxic or not clean:
        return flat
    t, c = (Counter(w for s in some for w in set(s)) for some in (toxic, clean))
    words = sorted(t.keys() | c.keys())
    index = {w: i for i, w in enumerate(words)}
    in_toxic, in_clean = (np.array([n[w] for w in words], float) for n in (t, c))
    more = np.where([len(_NOT_LETTER.sub("", w)) > 1 for w in words], in_toxic - 2 * len(toxic) / len(clean) * in_clean, -np.inf)
    marks = [words[i] for i in np.argsort(-more, kind="stable")[: 3 * LANDMARKS // 4]] + [words[i] for i in np.argsort(-in_clean, kind="stable")[: LANDMARKS // 4]]
    landmarks = dense(list(dict.fromkeys(marks)))
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    root = (vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])).astype(np.float32)
    x = np.empty((len(words), root.shape[1]), np.float16)  # the words in the space of the landmarks
    for k in range(0, len(words), 4_096):
        x[k : k + 4_096] = kernel(words[k : k + 4_096], landmarks) @ root
    width = max(map(len, toxic))
    bags = np.array([[index[w] for w in s] + [len(words)] * (width - len(s)) for s in toxic], np.int32)
    del found, clean, t, c, index
    negative, insults, some = np.flatnonzero(in_clean), in_toxic, np.random.default_rng(7)
    margin = np.ones(len(words) + 1)
    for step in range(ROUNDS):
        who = np.flatnonzero(insults)
        mass = insults[who] * toxic_weight
        parts = [(x, who, np.ones(len(who)), mass)]
        if step:
            # In disguise a word shall stand nearly as far out as plain.
            hidden = [(v, min(margin[i], HIDDEN_GOAL), n) for i, n in zip(who, mass) for v in disguised(words[i], some)]
            parts.append((kernel([v for v, _, _ in hidden], landmarks) @ root, np.arange(len(hidden)), *(np.array(c) for c in list(zip(*hidden))[1:])))
        # In the first round nearly all that is called an insult is none, so the classes are held in balance.
        parts.append((x, negative, -np.ones(len(negative)), in_clean[negative] * (clean_weight if step else 3 * mass.sum() / in_clean.sum())))
        w, bias = fit_svm(parts, COSTS[step > 0])
        margin = np.concatenate([*(x[k : k + 8_192].astype(np.float32) @ w + bias for k in range(0, len(words), 8_192)), [-2.0]])
        # The first boundary lies where hardly a clean word is; from then on it is the machine's own.
        border = 0.0 if step else max(float(np.quantile(np.repeat(margin[negative], in_clean[negative].astype(int)), 0.9995)), -0.5)
        insults = np.bincount(bags[margin[bags] > border], minlength=len(words) + 1)[: len(words)].astype(float)
        if not insults.any():
            return flat
    model = ToxicModel((landmarks @ (root @ w)).astype(np.float32), bias, flat.curves)
    tops = top_margins(sample, model).join(sample.select("doc_id", "toxic"), "doc_id").toPandas()  # 2 x FIT_DOCS rows at most
    margins, toxic_docs = np.stack(tops["margins"].to_numpy()), tops["toxic"].to_numpy(float)
    model.curves = [rising_share(m, toxic_docs) for m in margins.T]
    return model


def rising_share(margin: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the margin: where each step begins, and its share, drawn to the overall one by one text."""
    at, which = np.unique(margin, return_inverse=True)
    steps: list[list[float]] = []
    for m, n, k in zip(at, np.bincount(which), np.bincount(which, toxic)):
        steps.append([m, n, k])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, n, k = steps.pop()
            steps[-1][1] += n
            steps[-1][2] += k
    share = [(k + toxic.mean()) / (n + 1) for _, n, k in steps]
    return np.array([m for m, _, _ in steps]), np.maximum.accumulate(share)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.7) and top_margin of every row; only ``text`` is looked at.

    A null or empty text, or one without letters, has a low score. Repeated
    rows stay repeated, other columns are ignored, an empty table gives no
    rows. Texts are whole.
    """
    margins = F.col("margins")

    def share(rank: int, at: np.ndarray, shares: np.ndarray):
        steps = F.array(*[F.lit(float(x)) for x in at])
        reached = F.size(F.filter(steps, lambda x: x <= margins[rank]))
        return F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in shares]), reached - 1), F.lit(0.0))

    found = F.greatest(*[share(i, *curve) for i, curve in enumerate(model.curves)])
    scored = top_margins(docs, model).withColumn("score", found)
    return scored.select("doc_id", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), margins[0].alias("top_margin"))
