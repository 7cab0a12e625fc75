"""Reading and writing JSON banks, text corpora and snapshots, with the place of every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A question as it stands in a bank file.
QUESTION = "id string, cluster string, level string, instructionalArea string, performanceIndicator string, question string, options map<string,string>, answer string, explanation string, difficulty string, verified boolean"


def scan_bank(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rows of JSON array files with ``file`` and ``pos`` (bank order: path, then place in the array).

    An unknown or missing tier reads as medium. ``strict`` fails on a file that
    is no JSON; else its rows are left out.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = text.select("file", F.posexplode(F.from_json("value", f"array<struct<{_colons(QUESTION)}>>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})).alias("pos", "q"))
    tier = F.when(F.lower("difficulty").isin("easy", "medium", "hard"), F.lower("difficulty")).otherwise("medium")
    return rows.select("file", "pos", "q.*").withColumn("difficulty", tier)


def _colons(ddl: str) -> str:
    return ", ".join(x.strip().replace(" ", ":", 1) for x in _split(ddl))


def _split(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files without ``#`` comments, bullets and blanks."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"^\s*[-*•]\s*", ""))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line")).filter(F.length("line") > 0)


def scan_blocks(spark: SparkSession, path: str, header: str = r"(?m)^(?=Question:)") -> DataFrame:
    """Blocks of whole files that each begin with a header line, with their place."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", header)).alias("pos", "block"))
    return text.withColumn("block", F.trim("block")).filter(F.length("block") > 0)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Questions from labelled blocks; ``valid`` if all seven labels stand there once."""
    labels = ["Question", "A", "B", "C", "D", "Answer", "Explanation"]
    field = lambda x: F.regexp_extract("block", rf"(?m)^{x}[:.)][ \t]*(.*)$", 1)
    once = lambda x: F.regexp_count("block", F.lit(rf"(?m)^{x}[:.)]")) == 1
    valid = F.lit(True)
    for x in labels:
        valid = valid & once(x)
    options = F.create_map(*[c for x in "ABCD" for c in (F.lit(x), field(x))])
    return blocks.select("file", "pos", field("Question").alias("question"), options.alias("options"), F.upper(F.trim(field("Answer"))).alias("answer"), field("Explanation").alias("explanation"), valid.alias("valid"))


def write_bank(rows: DataFrame, path: str) -> None:
    """One folder per cluster, level and section, so that a reader prunes to the slice it wants."""
    rows.write.mode("overwrite").partitionBy("cluster", "level", "section").parquet(path)


def write_snapshot(rows: DataFrame, path: str, ref: str) -> None:
    """A version of a table under its name; an existing one is never overwritten."""
    rows.write.mode("errorifexists").parquet(f"{path}/snapshot={ref}")


def read_snapshot(spark: SparkSession, path: str, ref: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/snapshot={ref}")
