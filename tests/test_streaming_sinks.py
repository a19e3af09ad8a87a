import datetime as dt
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.streaming.monitor import read_sink, start_monitor, window_counters, write_epoch


def _ev(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, label_Y int, pred_Y int")


def test_stream_drops_late_rows_and_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="eq-stream-")
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    # Spark drops a row once it is behind the watermark of the *previous* batch
    # (the late-events watermark); it may still aggregate it in the batch that moves it.
    batches = [
        [(1, t(10, 5), "a", 1, 1), (2, t(10, 20), "b", 0, 1), (3, t(10, 40), "a", 0, 0)],
        [(4, t(12, 30), "b", 1, 0), (5, t(13, 10), "a", 1, 1)],     # watermark moves to 12:10
        [(7, t(13, 20), "b", 0, 0)],                                # 12:10 is now the late-events watermark
        [(6, t(10, 50), "a", 1, 0)],                                # late: dropped
        [(8, t(16, 0), "a", 0, 0)],                                 # closes the 12:00 and 13:00 windows
    ]
    schema = _ev(spark, batches[0]).schema
    for i, b in enumerate(batches):
        _ev(spark, b).coalesce(1).write.parquet(f"{root}/src/part={i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/src/*")
    q = start_monitor(spark, src, "event_type", f"{root}/out", f"{root}/ckpt", window="1 hour",
                      watermark="1 hour")
    q.awaitTermination()
    got = read_sink(spark, f"{root}/out", "counters")
    ten = {r["group_value"]: r["n"] for r in got.where(F.hour("window_start") == 10).collect()}
    assert ten == {"a": 2, "b": 1}                  # the late 10:50 row was dropped
    # in-time rows equal the batch computation over the same closed windows
    allrows = _ev(spark, [r for b in batches for r in b if r[0] != 6])
    batch = window_counters(allrows, "event_type", window="1 hour", watermark=None)
    closed = batch.where(F.col("window_end") <= F.lit(dt.datetime(2024, 1, 1, 15, 0)))
    key = lambda df: sorted((str(r["window_start"]), r["group_value"], r["n"], r["tp"]) for r in df.collect())
    assert key(got) == key(closed)


def test_replayed_batch_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="eq-replay-")
    t = dt.datetime(2024, 1, 1, 10, 5)
    rows = _ev(spark, [(1, t, "a", 1, 1), (2, t, "b", 0, 1), (3, t, "a", 0, 0)])
    counters = window_counters(rows, "event_type", window="1 hour", watermark=None)
    for epoch in (0, 1, 0):
        write_epoch(counters if epoch == 0 else counters.limit(0), epoch, root)
    assert read_sink(spark, root, "counters").count() == 2 and read_sink(spark, root, "metrics").count() == 13


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from equilens import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_mahalanobis_matches_numpy(spark):
    from equilens.operators.vectors import mahalanobis_to_centroid
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    lab = [i % 2 for i in range(40)]
    df = spark.createDataFrame([(i, x[i].tolist(), lab[i]) for i in range(40)], "id long, v array<double>, g int")
    got = {r["id"]: r["dist"] for r in mahalanobis_to_centroid(df, "v", "g", "id").collect()}
    vi = np.linalg.inv(np.cov(x.T))
    for i in range(40):
        c = x[[j for j in range(40) if lab[j] == lab[i]]].mean(axis=0)
        d = x[i] - c
        assert got[i] == pytest.approx(float(np.sqrt(d @ vi @ d)), rel=1e-9)


def test_run_log_sink_roundtrip(spark):
    from equilens.plans.run import before_after, metric_series, write_run
    mh = spark.createDataFrame([("r1", 0, "ACC", None, 0.7), ("r1", 1, "ACC", None, 0.72),
                                ("r1", 0, "SP", "o", 0.2), ("r1", 1, "SP", "o", 0.1)],
                               "run_id string, iteration int, metric string, protected string, value double")
    it = spark.createDataFrame([("r1", 0, 0.0, None, None, "{}"), ("r1", 1, 1.0, "o", "x", json.dumps({"x": "dropped"}))],
                               "run_id string, iteration int, ts double, selected_protected string, "
                               "selected_attr string, changes string")
    fs = spark.createDataFrame([("r1", 1, 2, "max_iterations", "{}", 0.1, 0.8)],
                               "run_id string, total_iterations int, max_iterations int, termination_reason string, "
                               "changes string, epsilon_threshold double, accuracy_threshold double")
    out = tempfile.mkdtemp(prefix="eq-log-")
    write_run(mh, it, fs, out)
    assert spark.read.parquet(f"{out}/run_metrics").count() == 4
    assert spark.read.json(f"{out}/run_json").count() == 2
    ba = {(r["metric"], r["iteration"]): r["delta_previous"] for r in before_after(mh).collect()}
    assert ba[("ACC", 1)] == pytest.approx(0.02) and ba[("SP", 1)] == pytest.approx(-0.1)
    ms = {(r["metric"], r["iteration"]): r["value"] for r in metric_series(mh).collect()}
    assert ms[("SP", 0)] == pytest.approx(0.2)


def test_feed_of_a_delivery_has_many_files_in_one_batch(spark, tmp_path):
    """A delivery is written by several tasks, and its rows enter the stream as one micro-batch."""
    from equilens import queries_core as qc
    spark.range(4000).selectExpr("id as event_id", "timestamp_seconds(id * 60) as ts").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "8k")
    try:
        files, rows = [], []
        for n in qc._feed(spark, str(tmp_path), f"{tmp_path}/in"):
            files.append(n)
            src = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", n).parquet(f"{tmp_path}/in/*")
            q = src.writeStream.foreachBatch(lambda b, e: rows.append(b.count())).trigger(availableNow=True) \
                .option("checkpointLocation", f"{tmp_path}/ckpt").start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(files) == qc.FEED_PARTS and min(files) > 1
    assert len(rows) == qc.FEED_PARTS and sum(rows) == 4000
