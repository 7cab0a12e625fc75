"""Helpers that several operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenbank.sources.storage import saved

__all__ = ["SEED", "counted", "gathered", "key_of", "map_rows", "saved", "shingle_hashes", "small_side", "table", "training_half"]

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows taken from an Arrow batch at a time, so that long texts don't pile up in a worker.
SLICE = 128

#: Bytes of an Arrow batch that a worker is sent; by rows alone, one of long texts has tens of MB, in the JVM and in the worker.
BATCH = 4 << 20

#: Seed of the hashes of shingles.
SEED = 42

#: Bytes that a partition of a counted frame has, where it would have fewer.
PART = 1 << 20

_WORD = re.compile(WORD.encode())
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple] | list]], schema: str) -> DataFrame:
    """Rows made from rows, per task and in Arrow batches.

    ``make`` runs once per task and gives a function that takes the columns of
    one row and returns the rows to emit. Only the current slice is held. The
    session's Arrow batches are cut at ``BATCH`` bytes from then on.
    """
    kind = StructType.fromDDL(schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def run(batches):
        fn, arrow = make(), to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [row for values in zip(*(c.to_pylist() for c in part.columns)) for row in fn(*values)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def counted(df: DataFrame, row_bytes: Column | int = 16) -> tuple[DataFrame, int, int]:
    """The frame as :func:`saved`, its rows and its bytes (``row_bytes`` a row), which are counted while it is written.

    It is read back in partitions of ``PART`` bytes if it was written in smaller
    ones, so that steps over few rows have few tasks and leave few files.
    """
    seen = Observation()
    each = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias("bytes")))
    rows, size = seen.get["rows"], seen.get["bytes"]
    return out.coalesce(size // PART + 1), rows, size


def gathered(df: DataFrame, row_bytes: Column | int = 16) -> DataFrame:
    """The frame alone of :func:`counted`."""
    return counted(df, row_bytes)[0]


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """A join side that was counted: broadcast up to ``most_rows``, else left to a shuffled join.

    Pass a saved frame of a few narrow columns, or the count computes it again.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def training_half(doc_id) -> F.Column:
    """True for documents that models may learn from: crc32 of the id's text, mod 3, isn't 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def key_of(df: DataFrame, columns: list[str] | None = None) -> F.Column:
    """128 bits of a row's values in ``columns`` (all of them if None); rows alike in them, nulls included, have one key.

    Stages use it to say which rows go: a doc_id may be null, or stand on several rows.
    """
    parts = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType.simpleString()
        value = F.col(f"`{c}`")
        # Maps and variants have no hash.
        parts += [F.to_json(F.struct(value)) if "map<" in kind or "variant" in kind else value, F.isnull(value)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle of the lower-cased (A-Z) text, repeats included; of the whole sequence if there are fewer words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = (ends - [len(w) + 1 for w in words]).tolist(), (ends - 1).tolist()
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    n = min(n, len(words))
    return np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])), np.uint64, len(words) - n + 1)
