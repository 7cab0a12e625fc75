"""Repairs over a table: all of them or none, with the reasons, published as one snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbank.sources.snapshots import Snapshots
from lumenbank.sources.storage import saved


def judged(base: DataFrame, repairs: DataFrame, key: str, identity: list[str], columns: list[str], answer: str | None = None, assigned: DataFrame | None = None, expected: DataFrame | None = None, gates: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their repairs, what is wrong with the repairs, and what was put right on the way.

    A repair may change ``columns`` alone; its ``identity`` columns must equal
    the row's. Two differences are let through: one of letter case, where the
    row's spelling is kept, and an ``answer`` that the row has wrong and the
    repair sets to what ``assigned`` (key, answer) says. Wrong are (key, reason):
    a repair without a key, repaired twice, outside ``expected``, without a row or with two, another identity, or
    one whose repaired row fails one of ``gates``. Notes are (key, note).
    """
    r = repairs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*identity, *columns]])
    counts = r.groupBy("_key").agg(F.count("*").alias("_repairs"))
    held = base.groupBy(key).agg(F.count("*").alias("_rows"))
    sides = counts.join(held, F.col("_key") == F.col(key), "left")
    reason = F.when(F.col("_key").isNull(), "without a key").when(F.col("_repairs") > 1, "repaired twice").when(F.col("_rows").isNull(), "without a row").when(F.col("_rows") > 1, "in two rows")
    wrong = [sides.select(F.col("_key").alias(key), reason.alias("reason")).filter("reason IS NOT NULL")]
    if expected is not None:
        wrong.append(counts.join(expected.select(F.col(key).alias("_key")).distinct(), "_key", "left_anti").filter("_key IS NOT NULL").select(F.col("_key").alias(key), F.lit("out of scope").alias("reason")))

    joined = base.join(r.dropDuplicates(["_key"]), F.col(key) == F.col("_key"), "left")
    want = F.lit(None)
    if answer is not None and assigned is not None:
        joined = joined.join(assigned.groupBy(F.col(key).alias("_assigned_key")).agg(F.min(answer).alias("_want")), F.col(key) == F.col("_assigned_key"), "left")
        want = F.col("_want")
    hit = F.col("_key").isNotNull()
    differs = {c: hit & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity}
    kind = {k.name: k.dataType.simpleString() for k in base.schema}
    case = {c: F.coalesce(F.lower(c) == F.lower(f"_{c}"), F.lit(False)) if kind[c] == "string" else F.lit(False) for c in identity}
    set_right = F.coalesce((F.col(f"_{answer}") == want) & ~F.col(answer).eqNullSafe(want), F.lit(False)) if answer in identity else F.lit(False)
    allowed = {c: case[c] | (set_right if c == answer else F.lit(False)) for c in identity}
    drift = F.array_compact(F.array(*[F.when(differs[c] & ~allowed[c], F.lit(f"changes {c}")) for c in identity]))
    said = F.array_compact(F.array(*[F.when(differs[c] & allowed[c], F.when(set_right, F.lit(f"{c} set to what was assigned")).otherwise(F.lit(f"{c} kept as it was spelt")) if c == answer else F.lit(f"{c} kept as it was spelt")) for c in identity]))
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    if answer in identity:
        new[answer] = F.when(hit & set_right, F.col(f"_{answer}")).otherwise(F.col(answer))
    rows = saved(joined.withColumns({"_drift": drift, "_said": said, "_hit": hit}).select(*[new.get(c, F.col(c)).alias(c) for c in base.columns], "_drift", "_said", "_hit"))
    fired = F.array_compact(F.array(*[F.when(test, F.lit(f"fails {name}")) for name, test in (gates or {}).items()])) if gates else F.array().cast("array<string>")
    wrong.append(rows.filter("_hit").select(key, F.explode(F.concat("_drift", fired)).alias("reason")))
    return rows.drop("_drift", "_said", "_hit"), reduce(DataFrame.unionByName, wrong), rows.select(key, F.explode("_said").alias("note"))


def apply(table: Snapshots, repairs: DataFrame, key: str, identity: list[str], columns: list[str], **options) -> tuple[int | None, DataFrame]:
    """Publishes the repaired table, or nothing if one repair is wrong; the new version's number and the reasons, a saved frame."""
    rows, wrong, _ = judged(table.read(), repairs, key, identity, columns, **options)
    wrong = saved(wrong)
    return (None if wrong.limit(1).count() else table.publish(rows)), wrong
