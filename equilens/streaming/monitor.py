"""Fairness monitor over a scored stream.

Confusion counters per event-time window and protected group are kept in
streaming state (``withWatermark`` bounds lateness; rows later than the
watermark are dropped by the engine).  Append mode emits a window once the
watermark passes its end, so windows that are still open stay in state;
``foreachBatch`` derives the 13 pairwise metrics of each closed window and
writes both tables into a folder of its epoch.  A batch that is run again
overwrites its folder, so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.operators.confusion import with_rates
from equilens.operators.fairness import fairness_from_confusion


def window_counters(events: DataFrame, protected: str, ts: str = "ts", window: str = "1 day",
                    slide: str | None = None, watermark: str = "1 hour", label: str = "label_Y",
                    pred: str = "pred_Y", score: str | None = None) -> DataFrame:
    y = F.coalesce(F.col(label) != 0, F.lit(False))
    p = F.coalesce(F.col(pred) != 0, F.lit(False))
    s = F.col(score) if score else F.col(pred).cast("double")
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    src = events.withWatermark(ts, watermark) if watermark else events
    return (src.groupBy(w.alias("window"), F.coalesce(F.col(protected).cast("string"), F.lit("NaN")).alias("group_value"))
               .agg(F.count(F.lit(1)).cast("long").alias("n"), cnt(p & y).alias("tp"), cnt(p & ~y).alias("fp"),
                    cnt(~p & y).alias("fn"), cnt(~p & ~y).alias("tn"),
                    cnt(F.col(label) == 1).alias("n_pos"), cnt(F.col(label) == 0).alias("n_neg"),
                    F.sum(F.when(F.col(label) == 1, s)).alias("sum_score_pos"),
                    F.sum(F.when(F.col(label) == 0, s)).alias("sum_score_neg"))
               .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       F.lit(protected).alias("protected"), "group_value", "n", "tp", "fp", "fn", "tn",
                       "n_pos", "n_neg", "sum_score_pos", "sum_score_neg"))


def window_metrics(counters: DataFrame) -> DataFrame:
    """``(window_start, window_end, metric, protected, value)`` from closed-window counters."""
    return fairness_from_confusion(with_rates(counters), by=["window_start", "window_end"])


def write_epoch(counters: DataFrame, epoch_id: int, out_dir: str) -> None:
    """Counters and metrics of one micro-batch, replacing what an earlier attempt left."""
    batch = counters.persist()
    batch.write.mode("overwrite").parquet(f"{out_dir}/counters/epoch={epoch_id}")
    window_metrics(batch).write.mode("overwrite").parquet(f"{out_dir}/metrics/epoch={epoch_id}")
    batch.unpersist()


def read_sink(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """The ``counters`` or ``metrics`` of all epochs."""
    return spark.read.option("basePath", f"{out_dir}/{table}").parquet(f"{out_dir}/{table}").drop("epoch")


def start_monitor(spark: SparkSession, source: DataFrame, protected: str, out_dir: str, checkpoint: str,
                  available_now: bool = True, **kw):
    """Start the monitor; returns the StreamingQuery (``awaitTermination`` for availableNow)."""
    counters = window_counters(source, protected, **kw)

    def sink(batch: DataFrame, epoch_id: int):
        write_epoch(batch, epoch_id, out_dir)

    w = counters.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def scored_event_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """The events fixture as a file stream: label = value > 5, prediction = user_id % 2."""
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 5).cast("int").alias("label_Y"),
                     (F.col("user_id") % 2).cast("int").alias("pred_Y"))
