"""Reports over what raters flagged under different lenses, and snapshots compared by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lens_report(flags: DataFrame, raters: DataFrame, controls: DataFrame, least_found: float = 0.8, most_spread: float = 0.5) -> DataFrame:
    """A row for each lens of ``raters`` (lens, rater): what they flagged (lens, rater, id), together and all of them, and how far to trust it.

    ``by_any`` and ``by_all`` count ids flagged by one rater or by every one;
    spread is the difference between the rater with most and with fewest flags,
    as a share of the most; a rater without flags counts with 0. Of the
    ``controls`` (id), known defects, ``refound`` were flagged by all raters. Credible: enough controls refound, and not too wide a spread.
    """
    flags = flags.distinct()
    people = raters.distinct()
    sizes = people.groupBy("lens").agg(F.count("*").alias("raters"))
    per = people.join(flags.groupBy("lens", "rater").agg(F.count("*").alias("n")), ["lens", "rater"], "left").groupBy("lens").agg(F.max(F.coalesce("n", F.lit(0))).alias("most"), F.min(F.coalesce("n", F.lit(0))).alias("fewest"))
    ids = flags.join(people, ["lens", "rater"], "left_semi").groupBy("lens", "id").agg(F.count("*").alias("votes")).join(sizes, "lens")
    known = controls.select("id").distinct().withColumn("control", F.lit(True))
    counts = ids.join(known, "id", "left").withColumn("whole", F.col("votes") == F.col("raters"))
    counts = counts.groupBy("lens").agg(F.count("*").alias("by_any"), F.count_if("whole").alias("by_all"), F.count_if(F.col("whole") & F.col("control")).alias("refound"))
    out = sizes.join(per, "lens").join(counts, "lens", "left").na.fill(0).join(F.broadcast(controls.agg(F.count_distinct("id").alias("controls"))))  # one row
    spread = F.coalesce((F.col("most") - F.col("fewest")) / F.when(F.col("most") > 0, F.col("most")), F.lit(0.0))
    found = F.coalesce(F.col("refound") / F.when(F.col("controls") > 0, F.col("controls")), F.lit(0.0))
    return out.select("lens", "raters", "by_any", "by_all", "refound", "controls", F.round(spread, 6).alias("spread"), ((found >= least_found) & (spread <= most_spread)).alias("credible"))


def positional_diff(before: DataFrame, after: DataFrame, place: list[str], key: str, frozen: list[str], mutable: list[str]) -> DataFrame:
    """(place columns, change): rows of two snapshots that stand on the same place, in strict mode.

    A place that is gone or new, one that holds another key, a frozen column
    that drifted (null is a value), or an allowed change, the first that holds; places whose rows are the same are left out.
    """
    a, b = before.select(*place, *[F.col(c).alias(f"_a_{c}") for c in [key, *frozen, *mutable]], F.lit(True).alias("_a")), after.select(*place, *[F.col(c).alias(f"_b_{c}") for c in [key, *frozen, *mutable]], F.lit(True).alias("_b"))
    same = lambda cols: reduce(lambda x, y: x & y, [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in cols], F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "vanished").when(~same([key]), "another row").when(~same(frozen), "frozen").when(~same(mutable), "changed")
    return a.join(b, place, "full_outer").select(*place, change.alias("change")).filter("change IS NOT NULL")
