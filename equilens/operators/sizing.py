"""Size-checked broadcast, and tables written once in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.session import ensure_checkpoint_dir


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: computed once, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/equilens-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``max_rows`` rows.

    The count runs one job on the (already aggregated) small side; above the
    bound the table is returned unchanged and Catalyst/AQE plan a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
