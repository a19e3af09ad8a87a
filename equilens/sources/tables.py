"""Table loading by path or catalogue name, preview and export sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

READERS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def read_path(spark: SparkSession, path: str, schema=None, json_records_array: bool = True) -> DataFrame:
    """Dispatch on the file suffix: CSV (header, inferred types), JSON (a records array by
    default, JSON lines with ``json_records_array=False``), Parquet."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in READERS:
        raise ValueError(f"unsupported file type: {ext or path}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if ext == ".csv":
        return r.option("header", True).option("inferSchema", schema is None).csv(path)
    if ext == ".json":
        return r.option("multiLine", json_records_array).json(path)
    return r.parquet(path)


def load_table(spark: SparkSession, path: str | None = None, name: str | None = None,
               data_dir: str | None = None, schema=None, json_records_array: bool = True) -> DataFrame:
    """``name`` wins over ``path``: a catalogue table, else ``<data_dir>/<name>`` (with a known
    suffix, tried in order).  Unknown suffix or name raises ``ValueError``."""
    if name:
        if spark.catalog.tableExists(name):
            return spark.table(name)
        base = f"{data_dir.rstrip('/')}/{name}" if data_dir else name
        candidates = [base] if os.path.splitext(base)[1] else [base + ext for ext in READERS]
        for c in candidates:
            if os.path.splitext(c)[1].lower() in READERS and _exists(spark, c):
                return read_path(spark, c, schema, json_records_array)
        raise ValueError(f"unknown dataset: {name}")
    if path:
        return read_path(spark, path, schema, json_records_array)
    raise ValueError("either name or path is required")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def preview(df: DataFrame, order_cols=None, n: int = 10) -> DataFrame:
    """First ``n`` rows under a declared order (source order has no meaning in Spark)."""
    return df.orderBy(*(order_cols or df.columns)).limit(n)


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result or transformed table as parquet, csv (with header) or json."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
