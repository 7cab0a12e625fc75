"""Lookups in slices and archives, imports, payload identity, and small plans over the bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenbank.operators.bank import keep_first


def scan_slice(rows: DataFrame, cluster: str, level: str, section: str) -> DataFrame:
    """The questions of one set or pool; raises where the manifest has none."""
    found = rows.filter((F.col("cluster") == cluster) & (F.col("level") == level) & (F.col("section") == section))
    if found.isEmpty():
        raise LookupError(f"no {section} of {cluster} {level}")
    return found


def resolve(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of those (cluster, level, id) that are found; others have none.

    Only slices that are asked for are kept of ``rows`` before ids are joined; the slices are a few hundred.
    """
    asked = asked.select("cluster", "level", "id").distinct()
    slices = asked.select("cluster", "level").distinct()
    return rows.join(slices, ["cluster", "level"], "left_semi").join(asked, ["cluster", "level", "id"])


def scan_archive(spark: SparkSession, path: str, schema: str, defaults: dict[str, str]) -> DataFrame:
    """Day records below ``path``, one for each date: the least ordinal. Fields that a record lacks have their default; a record without a date is left out."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).na.fill(defaults)
    columns = [part.split()[0] for part in schema.split(", ")]
    return keep_first(rows.filter("date IS NOT NULL").select(*columns), ["date"], ["ordinal"])


def shelf_order(entries: DataFrame) -> DataFrame:
    """(shelf, id, place): entries in order of the number that their id ends in; an id without one is an error."""
    number = F.regexp_extract("id", "-([0-9]+)$", 1)
    ordinal = F.when(number == "", F.raise_error(F.concat(F.lit("no ordinal in "), "id"))).otherwise(number.cast("long"))
    return entries.withColumn("ordinal", ordinal).withColumn("place", F.row_number().over(W.partitionBy("shelf").orderBy("ordinal"))).select("shelf", "id", "place")


def import_rows(there: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``there`` and those of ``new`` whose key it lacks, each once: importing again changes nothing."""
    return there.unionByName(keep_first(new, [key], [key]).join(there.select(key), key, "left_anti"))


def curated_or_all(curated: DataFrame | None, rows: DataFrame) -> DataFrame:
    """(area, pi, curated): the curated indicators of areas that have some, and all the bank's of the others; all of them where nothing is curated."""
    every = rows.select("area", "pi").distinct().withColumn("curated", F.lit(False))
    if curated is None:
        return every
    return curated.select("area", "pi").distinct().withColumn("curated", F.lit(True)).unionByName(every.join(curated.select("area").distinct(), "area", "left_anti"))


def report(title: Column, fields: dict[str, Column]) -> Column:
    """A title and a line for each field, names padded to one width."""
    width = max(map(len, fields)) + 1
    lines = [F.concat(F.lit(f"  {name + ':':<{width}} "), value.cast("string")) for name, value in fields.items()]
    return F.concat_ws("\n", title, *lines)


def payload_identity(authored: DataFrame, payload: DataFrame, identity: dict[str, str], own: list[str]) -> DataFrame:
    """Authored rows with their identity fields from the payload, by its names, and ``own`` fields from the row itself where it has them.

    An identity field that the payload lacks is an error.
    """
    there = payload.select("id", *[F.col(b).alias(f"_{a}") for a, b in identity.items()], *[F.col(c).alias(f"_{c}") for c in own])
    joined = authored.join(there, "id")
    needed = [F.when(F.col(f"_{a}").isNull(), F.raise_error(F.concat(F.lit(f"no {a} for "), F.col("id").cast("string")))).otherwise(F.col(f"_{a}")).alias(a) for a in identity]
    return joined.select("id", *needed, *[F.coalesce(c, f"_{c}").alias(c) for c in own])


def weighted_sample(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows of each cluster drawn without replacement, the likelier the more they weigh (exponential keys)."""
    key = -F.log(1 - (F.rand() if seed is None else F.rand(seed))) / F.col("weight")
    # Each task first keeps what could win in it, so a large cluster is not sorted as a whole.
    local = W.partitionBy("cluster", "_part").orderBy("_key")
    some = rows.withColumns({"_key": key, "_part": F.spark_partition_id()}).withColumn("_nth", F.row_number().over(local)).filter(F.col("_nth") <= n)
    return some.withColumn("_nth", F.row_number().over(W.partitionBy("cluster").orderBy("_key"))).filter(F.col("_nth") <= n).drop("_key", "_part", "_nth")


def manual_tasks(rows: DataFrame, used: DataFrame) -> DataFrame:
    """(cluster, kind, target, questions): a task of each kind for each cluster, on the first indicator that is not in use; flashcards need none."""
    keys = ["cluster", "area", "pi"]
    free = rows.select(*keys).distinct().join(used.select(*keys).distinct(), keys, "left_anti").groupBy("cluster").agg(F.min(F.concat_ws("/", "area", "pi")).alias("first"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("questions")) for k, n in (("practice", 10), ("review", 5), ("flashcards", 20))])
    tasks = rows.select("cluster").distinct().withColumn("k", F.explode(kinds)).join(free, "cluster", "left")
    return tasks.select("cluster", "k.kind", F.when(F.col("k.kind") != "flashcards", F.col("first")).alias("target"), "k.questions")


def work_order(rows: DataFrame, depth: int) -> DataFrame:
    """(area, owed, short, unanswered): what a shelf owes to its depth, and its entries with blocking issues."""
    return rows.groupBy("area").agg(
        F.greatest(F.lit(depth) - F.count("*"), F.lit(0)).alias("owed"),
        F.count_if(F.length(F.trim("question")) < 40).alias("short"),
        F.count_if(F.col("answer").isNull()).alias("unanswered"),
    )
