"""Writing intermediate frames where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back: computed once, and safe when executors go."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = context.getConf().get("spark.checkpoint.dir")
        if not place:
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
            place = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(place)
    return df.checkpoint(eager=True)
