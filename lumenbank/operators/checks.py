"""Gates over rows: findings, tells, label joins, solver returns, overlays and identity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.functions import text as T
from lumenbank.operators.bank import values
from lumenbank.sources.adapters import LETTERS

# Words of absolute and combined options.
ABSOLUTE = r"(^|[^a-z])(always|never|all|none|only|every|must)([^a-z]|$)"
COMBINED = r"(all|none|both) of the above|both [a-d] and [a-d]"


def findings(rows: DataFrame, gates: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, finding): a row for each gate that fires, in one pass."""
    fired = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in gates.items()]))
    return rows.select(key, F.explode(fired).alias("finding"))


def option_gates() -> dict[str, Column]:
    """Row gates on options: empty or equal options, a missing key, absolute or combined wording, numbers in all of them."""
    options = values(F.col("options"))
    return {
        "empty option": F.exists(options, lambda o: F.length(o) == 0),
        "equal options": F.size(F.array_distinct(options)) < 4,
        "no key": ~F.col("answer").isin(LETTERS),
        "absolute": F.exists(options, lambda o: F.rlike(F.lower(o), F.lit(ABSOLUTE))),
        "combined": F.exists(options, lambda o: F.rlike(F.lower(o), F.lit(COMBINED))),
        "numeric": F.size(F.filter(options, lambda o: F.rlike(o, F.lit("[0-9]")))) >= 3,
    }


def shared_options(rows: DataFrame, least: int) -> DataFrame:
    """Normalised option texts of a least length that more than one question has, with their number of questions."""
    one = rows.select("id", F.explode(F.transform(values(F.col("options")), T.plain_norm)).alias("option")).filter(F.length("option") >= least)
    return one.groupBy("option").agg(F.count_distinct("id").alias("questions"), F.min("id").alias("first_id")).filter("questions > 1")


def solver_outcomes(keys: DataFrame, returns: DataFrame) -> DataFrame:
    """Per item: split among solvers, agreed against the key, or agreed with it."""
    votes = returns.groupBy("cand_id").agg(F.count_distinct("answer").alias("kinds"), F.min("answer").alias("said"), F.count("*").alias("solvers"))
    outcome = F.when(F.col("kinds") > 1, "split").when(F.col("said") != F.col("answer"), "against key").otherwise("agreed")
    return keys.join(votes, "cand_id").select("cand_id", "solvers", outcome.alias("outcome"))


def apply_labels(rows: DataFrame, labels: DataFrame, key: str, column: str, replace: bool) -> DataFrame:
    """Labels over a column: always where ``replace``, else only where the row has none."""
    found = rows.join(labels.select(key, F.col(column).alias("_label")), key, "left")
    pick = F.coalesce("_label", column) if replace else F.coalesce(column, "_label")
    return found.withColumn(column, pick).drop("_label")


def overlay(base: DataFrame, repairs: DataFrame, key: str, identity: list[str], columns: list[str]) -> DataFrame:
    """Repairs over base rows where the identity columns agree; ``state`` tells kept, repaired and refused."""
    r = repairs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*identity, *columns]])
    joined = base.join(r, F.col(key) == F.col("_key"), "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity], F.lit(True))
    state = F.when(F.col("_key").isNull(), "kept").when(same, "repaired").otherwise("refused")
    joined = joined.withColumn("state", state)
    return joined.withColumns({c: F.when(F.col("state") == "repaired", F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*base.columns, "state")


def exact_then_loose(rows: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """The catalogue's id by exact name, else by normalised name; ``match`` tells which, none included."""
    exact = catalogue.groupBy(name).agg(F.min("cat_id").alias("exact_id"))
    loose = catalogue.groupBy(T.plain_norm(F.col(name)).alias("_norm")).agg(F.min("cat_id").alias("loose_id"))
    found = rows.join(exact, name, "left").withColumn("_norm", T.plain_norm(F.col(name))).join(loose, "_norm", "left")
    match = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("loose_id").isNotNull(), "loose").otherwise("none")
    return found.select(*rows.columns, F.coalesce("exact_id", "loose_id").alias("cat_id"), match.alias("match"))


def best_match(asked: DataFrame, pool: DataFrame, group: str) -> DataFrame:
    """Of each asked row the pool row of its group with the most similar words; of equal ones the first id.

    Rows meet on a shared word, so no pair without one is ever formed, and
    similarity comes from counts.
    """
    a, b = asked.select(group, "id", F.explode("words").alias("w"), F.size("words").alias("na")), pool.select(group, F.col("id").alias("other"), F.explode("words").alias("w"), F.size("words").alias("nb"))
    both = a.join(b, [group, "w"]).filter("id <> other").groupBy("id", "other").agg(F.count("*").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    both = both.withColumn("score", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    return both.withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other"))).filter("_nth = 1").select("id", "other", "score")


def reused_within(uses: DataFrame, days: int) -> DataFrame:
    """Uses of a (code, name) that the same code had at most ``days`` before, with the day of the last one."""
    before = F.lag("day").over(W.partitionBy("code", "name").orderBy("day", "id"))
    return uses.withColumn("last_day", before).filter(F.datediff("day", "last_day") <= days)


def fill_forward(lines: DataFrame, group: str, order: str, header: Column) -> DataFrame:
    """Adds ``owner``, the last header value at or above each line."""
    return lines.withColumn("owner", F.last(header, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def proper_names(text: Column) -> Column:
    """Different runs of two or more capitalised words, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), 1))


def headings(line: Column) -> Column:
    """Lines of capitals: 4 to 90 characters, three letters at least."""
    return F.length(line).between(4, 90) & (F.upper(line) == line) & (F.length(F.regexp_replace(line, "[^A-Za-z]", "")) >= 3)


def label_divergence(rows: DataFrame) -> DataFrame:
    """Words that all options share, and of each option's rest the number of words; ``barely`` if less than a quarter is shared."""
    options = F.transform(values(F.col("options")), lambda o: F.array_distinct(T.tokens(o, 2)))
    rows = rows.select("id", options.alias("o"))
    shared = F.aggregate("o", F.get(F.col("o"), F.lit(0)), lambda s, x: F.array_intersect(s, x))
    rows = rows.withColumn("shared", F.size(shared)).withColumn("union", F.size(F.array_distinct(F.flatten("o"))))
    return rows.select("id", "shared", "union", (F.col("shared") * 4 < F.col("union")).alias("barely"))


def backoff_ms(tries: Column) -> Column:
    return F.least(F.lit(30_000), 1_000 * F.pow(F.lit(2), F.least(tries, F.lit(5)))).cast("int")
