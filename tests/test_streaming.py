"""Streams give what batches give."""

import datetime

from tidewire.operators import folds
from tidewire.plans import fixtures as fx
from tidewire.plans import fold_queries as q
from tidewire.streaming import operators as so
from tidewire.streaming.reporting import ProgressReport


def run(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def files(spark, df, tmp_path, parts):
    """df in `parts` files in the order of arrival, read one per micro-batch."""
    rows = df.orderBy("arrival").collect()
    folder = tmp_path / "in"
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_fold_over_a_stream(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", so.ROCKSDB)
    schema = "event_id long, accepted boolean, overrun boolean, frontier long"
    batch = fx.arrivals(spark, sf_dir).select("origin", "event_id", "seq", "arrival").limit(400)
    stream = files(spark, batch, tmp_path, 3)
    found = run(spark, so.stream_fold(stream, ["origin"], folds.tracker(q.WINDOW), schema), "fold_out", tmp_path)
    expected = folds.apply_fold(batch, ["origin"], folds.tracker(q.WINDOW), schema)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_idle_keys(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", so.ROCKSDB)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    folder = str(tmp_path / "idle")
    for rows in ([("a", at(0)), ("b", at(0))], [("b", at(50))], [("b", at(200))]):
        spark.createDataFrame(rows, "conn string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("conn string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "0 seconds")
    found = run(spark, so.stream_idle(stream, ["conn"], "ts", 60000), "idle_out", tmp_path)
    assert "a" in {r.conn for r in found.collect()}


def test_delivery_to_listeners(spark, tmp_path):
    folder = str(tmp_path / "msgs")
    spark.createDataFrame([("t1", "x"), ("t2", "y"), ("t3", "z")], "topic string, data string").write.parquet(folder)
    got, lines = [], []
    report = ProgressReport(lines.append)
    spark.streams.addListener(report)
    stream = spark.readStream.schema("topic string, data string").parquet(folder)
    query = so.deliver(stream, {"t1": lambda df, i: got.extend(r.data for r in df.collect()), "t2": lambda df, i: got.extend(r.data for r in df.collect())}, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    spark.streams.removeListener(report)
    assert sorted(got) == ["x", "y"]
