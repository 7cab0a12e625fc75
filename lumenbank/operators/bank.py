"""Operators on the question bank: lookups, search, facets, hashes, duplicates, snapshots, tells and tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.sources.adapters import LETTERS, LEVELS, TIERS
from lumenbank.sources.storage import saved

#: Rows of a counted side that may be broadcast.
BROADCAST_ROWS = 2_000_000


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; deterministic, unlike dropDuplicates."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def lookup_in_order(rows: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of the given ids with their place in the list; unknown ids are left out."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i,) for i in [ids]], "ids array<long>").select(F.posexplode("ids").alias("place", key))
    return rows.join(F.broadcast(asked), key)


def values(options: Column) -> Column:
    return F.array(*[options[x] for x in LETTERS])


def search(rows: DataFrame, needle: str, area: str | None = None, difficulty: str | None = None) -> DataFrame:
    """Area and tier equality, and a case-insensitive substring of question, indicator or any option."""
    if area:
        rows = rows.filter(F.col("area") == area)
    if difficulty:
        rows = rows.filter(F.col("difficulty") == difficulty)
    has = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
    return rows.filter(has(F.col("question")) | has(F.col("pi")) | F.exists(values(F.col("options")), has))


def facet_counts(rows: DataFrame, facets: dict[str, str | None]) -> DataFrame:
    """(facet, value, n): each facet counted under the other facets' filters; values without rows are kept with 0.

    One pass: every facet's condition becomes a conditional count, after the
    rows are first reduced to one per combination of facet values.
    """
    cube = rows.groupBy(*facets).agg(F.count("*").alias("n"))
    parts = []
    for name in facets:
        others = [F.col(k) == v for k, v in facets.items() if k != name and v is not None]
        under = reduce(lambda a, b: a & b, others, F.lit(True))
        parts.append(cube.groupBy(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")).agg(F.coalesce(F.sum(F.when(under, F.col("n"))), F.lit(0)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def manifest(rows: DataFrame) -> DataFrame:
    """A row per file: count, tiers and letters with zeros filled in."""
    tally = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return rows.groupBy("file", "cluster", "level", "section").agg(F.count("*").alias("n"), *[tally("difficulty", t) for t in TIERS], *[tally("answer", x) for x in LETTERS])


def area_counts(rows: DataFrame) -> DataFrame:
    """Questions of each area over a level's sets, or over its pools where the level has no set; summed over levels."""
    per = rows.groupBy("cluster", "level", "area").agg(F.count_if(F.col("section") == "sets").alias("sets"), F.count_if(F.col("section") == "pools").alias("pools"))
    any_set = F.sum("sets").over(W.partitionBy("cluster", "level")) > 0
    per = per.withColumn("n", F.when(any_set, F.col("sets")).otherwise(F.col("pools"))).filter("n > 0")
    return per.groupBy("cluster", "area").agg(F.sum("n").alias("n"))


def inventory(rows: DataFrame) -> DataFrame:
    """Sorted different indicators of each cluster, level and area; rows without area or indicator are skipped."""
    return rows.filter("area IS NOT NULL AND pi IS NOT NULL").groupBy("cluster", "level", "area").agg(F.array_sort(F.collect_set("pi")).alias("pis"))


def duplicate_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def collapse(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Survivors, the earliest of each key, and a receipt of what went and which row stands for it."""
    w = W.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumns({"_nth": F.row_number().over(w), "_kept": F.first("id").over(w)})
    gone = numbered.filter("_nth > 1").select(F.col("id").alias("removed_id"), F.col("_kept").alias("kept_id"))
    return numbered.filter("_nth = 1").drop("_nth", "_kept"), gone


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, frozen: list[str], mutable: list[str]) -> DataFrame:
    """(key, change): added, vanished, frozen (a column that may not change did) or changed; same rows are left out."""
    a, b = before.alias("a"), after.alias("b")
    same = lambda cols: reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols], F.lit(True))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "vanished").when(~same(frozen), "frozen").when(~same(mutable), "changed")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change")).filter("change IS NOT NULL")


def missing_foreign_duplicate(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Ids that did not come back, that were not asked for, or that came back more than once."""
    want = expected.select(key).distinct().withColumn("want", F.lit(True))
    got = returned.groupBy(key).agg(F.count("*").alias("n"))
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "foreign").when(F.col("n") > 1, "duplicate")
    return want.join(got, key, "full_outer").select(key, kind.alias("kind")).filter("kind IS NOT NULL")


def reconcile(returns: DataFrame) -> DataFrame:
    """Per item (cand_id, rater, verdict): DEFECTIVE by anyone, else agreed verdict, else split."""
    votes = returns.groupBy("cand_id").agg(F.count_if(F.col("verdict") == "DEFECTIVE").alias("defects"), F.count_distinct("verdict").alias("kinds"), F.min("verdict").alias("verdict"), F.count("*").alias("raters"))
    outcome = F.when(F.col("defects") > 0, "defective").when(F.col("kinds") > 1, "split").otherwise(F.concat(F.lit("agreed_"), F.lower("verdict")))
    return votes.select("cand_id", "raters", outcome.alias("outcome"))


def lengths(options: Column) -> Column:
    return F.transform(values(options), F.length)


def with_length_tells(rows: DataFrame) -> DataFrame:
    """Adds the key's length, its rank among the options (1: longest), ties and the margin to the longest other option."""
    rows = rows.withColumns({"lens": lengths(F.col("options")), "key_len": F.length(F.col("options")[F.col("answer")])})
    others = F.array(*[F.when(F.col("answer") != x, F.length(F.col("options")[x])) for x in LETTERS])
    return rows.withColumns(
        {
            "key_rank": F.size(F.filter("lens", lambda n: n > F.col("key_len"))) + 1,
            "ties": F.size(F.filter("lens", lambda n: n == F.array_max("lens"))),
            "margin": F.col("key_len") - F.array_max(others),
            "shortest": F.col("key_len") == F.array_min("lens"),
        }
    )


def length_stats() -> list[Column]:
    longest = F.col("key_rank") == 1
    return [
        F.count("*").alias("n"),
        F.count_if(longest).alias("among_longest"),
        F.count_if(F.col("margin") > 0).alias("strictly_longest"),
        F.count_if("shortest").alias("shortest"),
        F.count_if(F.col("margin") >= 5).alias("margin_5"),
        F.avg(F.when(longest, 1 / F.col("ties")).otherwise(0.0)).alias("pick_longest"),
        F.avg("key_len").alias("mean_key"),
    ]


def length_rollup(rows: DataFrame) -> DataFrame:
    """The same statistics for the bank, each section, each file's level and each cluster and level, in one Expand."""
    told = with_length_tells(rows)
    return told.groupingSets([[], [F.col("section")], [F.col("cluster"), F.col("level")], [F.col("section"), F.col("level")]], F.col("section"), F.col("cluster"), F.col("level")).agg(F.grouping_id().alias("grouping"), *length_stats())


def over_budget(rows: DataFrame, rate: float, least_margin: int) -> DataFrame:
    """Rows whose key is strictly longest beyond ``rate`` of a file's rows, worst first, and all with a large margin."""
    told = with_length_tells(rows)
    n = F.count("*").over(W.partitionBy("file"))
    longest = F.count_if(F.col("margin") > 0).over(W.partitionBy("file"))
    place = F.row_number().over(W.partitionBy("file").orderBy(F.desc("margin"), "id"))
    told = told.withColumns({"budget": F.floor(longest - F.floor(F.lit(rate) * n)), "place": place})
    return told.filter((F.col("margin") > 0) & ((F.col("place") <= F.col("budget")) | (F.col("margin") >= least_margin)))


def pattern_lift(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """For each wording pattern: rows where some option has it, those whose key has it, the chance of that, and the lift."""
    parts = []
    for name, regex in patterns.items():
        marks = F.size(F.filter(values(F.col("options")), lambda o: F.rlike(F.lower(o), F.lit(regex))))
        key = F.rlike(F.lower(F.col("options")[F.col("answer")]), F.lit(regex)).cast("int")
        parts.append(F.struct(F.lit(name).alias("pattern"), marks.alias("marks"), key.alias("key")))
    found = rows.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("marks > 0")
    return found.groupBy("pattern").agg(F.count("*").alias("tagged"), F.sum("key").alias("key_tagged"), F.avg(F.col("marks") / 4).alias("chance"), (F.avg("key") / F.avg(F.col("marks") / 4)).alias("lift"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(token, df, idf) over stems and options; idf = ln((n + 1) / (df + 1)) + 1."""
    text = F.concat_ws(" ", "question", *[F.col("options")[x] for x in LETTERS])
    found = rows.select(F.explode(F.array_distinct(T.tokens(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n"))
    return found.join(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def deficit(rows: DataFrame, target: int) -> DataFrame:
    """What each (cluster, level, area, pi) has and needs of each tier; null areas and indicators are skipped."""
    have = rows.filter("area IS NOT NULL AND pi IS NOT NULL").groupBy("cluster", "area", "pi", "level").agg(*[F.count_if(F.col("difficulty") == t).alias(f"have_{t}") for t in TIERS])
    pis = have.select("cluster", "area", "pi").distinct().withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    goal = F.bround(F.lit(target) / 3).cast("int")
    full = pis.join(have, ["cluster", "area", "pi", "level"], "left").na.fill(0)
    need = {f"need_{t}": F.greatest(F.lit(0), goal - F.col(f"have_{t}")) for t in TIERS}
    full = full.withColumns(need)
    return full.withColumn("need_total", sum((F.col(c) for c in need), F.lit(0)))


def most_common(rows: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """The commonest value of each key; of equally common ones that seen first."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(first).alias("at"))
    return keep_first(counted, [key], [F.desc("n"), F.col("at")]).select(key, value, "n")


def ngram_matches(published: DataFrame, corpus: DataFrame, n: int, most_docs: int) -> DataFrame:
    """(unit, start, gram, doc, docs): each published n-gram that the corpus has, without those in ``most_docs`` or more documents.

    The published n-grams go first: of the corpus, only n-grams whose 64-bit
    hash is among theirs leave the scan, so the rest of it is never shuffled.
    """
    words = lambda df, key: df.select(key, F.split(T.plain_norm(F.col("text")), " ").alias("w"))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    asked = words(published, "unit").select("unit", F.explode(T.word_ngrams(F.col("w"), n)).alias("g")).select("unit", "g.gram", "g.start")
    asked = saved(asked.withColumn("h", hashed(F.split("gram", " "))).withColumn("h", F.xxhash64(*[F.get("h", F.lit(k)) for k in range(n)])))
    keys = saved(asked.select("h").distinct())
    parts = words(corpus, "doc").select("doc", hashed(F.col("w")).alias("w"))
    each = F.transform(F.slice("w", 1, F.greatest(F.size("w") - n + 1, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("w", i + k) for k in range(1, n)]))
    found = parts.select("doc", F.explode(F.array_distinct(each)).alias("h")).join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "h").distinct()
    index = saved(found)
    rare = index.groupBy("h").agg(F.count("*").alias("docs")).filter(F.col("docs") < most_docs)
    return asked.join(index.join(rare, "h"), "h").drop("h")


def longest_runs(matches: DataFrame, n: int) -> DataFrame:
    """The longest run of neighbouring n-grams that one document shares with each unit (gaps and islands); words of the run."""
    island = F.col("start") - F.row_number().over(W.partitionBy("unit", "doc").orderBy("start"))
    rows = matches.select("unit", "doc", "start").distinct().withColumn("island", island)
    runs = rows.groupBy("unit", "doc", "island").agg((F.count("*") + n - 1).alias("words"), F.min("start").alias("start"))
    return keep_first(runs, ["unit"], [F.desc("words"), F.col("start"), F.col("doc")]).select("unit", "doc", "start", "words")


def pairs_sharing_bigrams(rows: DataFrame, ratio: float) -> DataFrame:
    """Pairs of different (id, question) rows, with ``n`` characters each, that may have the sequence ratio; none that has it is missed.

    The ratio's M matched characters stand in one order in both texts, and
    each of the n + m - 2M others parts two of them at most: 3M - 1 - n - m
    bigrams are common, with M >= ratio (n + m) / 2 and so m >= n ratio / (2 - ratio).
    A row is indexed by its rarest bigrams only, as many as it can lack plus
    one. Bigrams are numbered where they repeat. Texts under three characters
    reach no such ratio (from 0.81) with another.
    """
    ratio -= 1e-5  # room for a ratio that is rounded
    part = 1.5 * ratio - 1
    at = F.explode(F.sequence(F.lit(1), F.length("question") - 1)).alias("at")
    found = rows.withColumn("n", F.length("question")).filter("n > 2").select("id", "n", "question", at).withColumn("gram", F.expr("shiftleft(cast(ascii(substring(question, at, 1)) AS bigint), 21) + ascii(substring(question, at + 1, 1))"))
    # Two code points and the number of the repeat in one long: lists of structs meet by comparing all with all.
    found = found.select("id", "n", (F.shiftleft("gram", 21) + F.row_number().over(W.partitionBy("id", "gram").orderBy("at"))).alias("gram"))
    common = found.groupBy("gram").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "gram"))
    prefix = found.join(common, "gram").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(part * F.col("n") * (1 + ratio / (2 - ratio)) - 1 - 1e-9))
    a, b = prefix.select("gram", "id", "n"), prefix.select("gram", F.col("id").alias("other_id"), F.col("n").alias("other_n"))
    met = a.join(b, "gram").filter("id < other_id").filter(2 * F.least("n", "other_n") >= ratio * (F.col("n") + F.col("other_n"))).select("id", "other_id").distinct()
    texts = rows.select("id", "question", F.length("question").alias("n")).join(found.groupBy("id").agg(F.collect_list("gram").alias("grams")), "id")
    other = texts.select(*[F.col(c).alias(f"other_{c}") for c in texts.columns])
    both = F.size(F.array_intersect("grams", "other_grams"))
    return met.join(texts, "id").join(other, "other_id").filter(both >= part * (F.col("n") + F.col("other_n")) - 1 - 1e-9).drop("grams", "other_grams")


def largest_remainder(rows: DataFrame, group: list[str], share: str, total: str, order: str) -> DataFrame:
    """Adds ``quota``: whole parts of total * share / sum(share), leftovers to the largest remainders, ties by ``order``."""
    w = W.partitionBy(*group)
    exact = F.col(total) * F.col(share) / F.sum(share).over(w)
    rows = rows.withColumns({"_floor": F.floor(exact), "_rest": F.round(exact - F.floor(exact), 9)})
    left = F.col(total) - F.sum("_floor").over(w)
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("_rest"), order))
    return rows.withColumn("quota", F.col("_floor") + F.when(place <= left, 1).otherwise(0)).drop("_floor", "_rest")
