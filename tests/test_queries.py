"""Every query that has SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tidewire.operators import delivery, sequencing
from tidewire.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cursor = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["origin_seq", "link_seq", "frontier", "gaps", "strict_order"])
def test_same_rows_by_ranges(spark, sf_dir, db, name, monkeypatch):
    """The plans of large inputs, with ranges that the small ones cross."""
    monkeypatch.setattr(sequencing, "ONE_TASK", -1)
    monkeypatch.setattr(sequencing, "SPAN", 100)
    test_same_rows(spark, sf_dir, db, name)


@pytest.mark.parametrize("name", ["fanout", "fanout_temporal", "all_deliveries"])
def test_same_rows_by_blocks(spark, sf_dir, db, name, monkeypatch):
    """Blocks and chunks of which the small inputs have several."""
    monkeypatch.setattr(delivery, "BLOCK", 1)
    monkeypatch.setattr(delivery, "CHUNK_BYTES", 256)
    test_same_rows(spark, sf_dir, db, name)


@pytest.mark.parametrize("name", ["fanout", "fanout_temporal", "all_deliveries"])
def test_same_rows_by_bands(spark, sf_dir, db, name, monkeypatch):
    """Several bands of blocks per topic."""
    monkeypatch.setattr(delivery, "BAND", 2)
    test_same_rows_by_blocks(spark, sf_dir, db, name, monkeypatch)


@pytest.mark.parametrize("block", [256, 1])
def test_fan_out_of_odd_rows(spark, block, monkeypatch):
    """Repeated and null rows, windows that overlap or are open, columns of any name and type: as plain loops have it."""
    monkeypatch.setattr(delivery, "BLOCK", block)
    sent = [("a", 5, {"k": 1}, "x"), ("a", 5, {"k": 1}, "x"), ("b", 7, None, None), (None, 5, None, "z"), ("c", 1, {}, "w"), ("a", None, {}, "v")]
    held = [(1, "a", 0, 6), (1, "a", 0, 6), (1, "a", 5, 9), (2, "a", 6, 9), (None, "b", 7, 8), (3, "d", 0, 9), (4, None, 0, 9), (5, "a", None, 9), (6, "b", 0, 7), (7, "a", 5, 5)]
    m = spark.createDataFrame(sent, "topic string, ts_ms long, props map<string,int>, `odd.name` string")
    s = spark.createDataFrame(held, "client_id long, topic string, from_ms long, to_ms long")
    row = lambda t, ts, p, o, c: (t, ts, p, o, c)
    every = [row(*x, c) for x in sent for c, t in {(c, t) for c, t, *_ in held} if t is not None and t == x[0]]
    now = [row(*x, c) for x in sent for c, t, a, b in set(held) if t is not None and t == x[0] and None not in (x[1], a, b) and a <= x[1] < b]
    for got, want in ((delivery.fan_out(m, s), every), (delivery.fan_out_current(m, s), now)):
        assert got.columns == ["topic", "ts_ms", "props", "odd.name", "client_id"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) != []
    assert delivery.fan_out(m.limit(0), s).collect() == delivery.fan_out_current(m, s.limit(0)).collect() == []


def test_fan_out_takes_little_room(spark, tmp_path):
    """Many clients of each topic, messages of all topics in turn and in one file: below a byte a row, by several tasks."""
    spark.range(2000).selectExpr("id AS event_id", "concat('t', id % 5) AS topic", "1000 + id AS ts_ms").coalesce(1).write.parquet(f"{tmp_path}/m")
    subs = spark.range(15_000).selectExpr("id AS client_id", "concat('t', id % 5) AS topic", "id % 4 AS from_ms", "9999L AS to_ms")
    m = spark.read.parquet(f"{tmp_path}/m")
    for k, df in enumerate((delivery.fan_out(m, subs), delivery.fan_out_current(m, subs))):
        df.select("event_id", "client_id").write.parquet(f"{tmp_path}/{k}")
        files = [p.stat().st_size for p in (tmp_path / str(k)).glob("*.parquet")]
        assert spark.read.parquet(f"{tmp_path}/{k}").count() == 2000 * 3_000
        assert len(files) > 1 and sum(files) < 2000 * 3_000


def most_generated(plan):
    """The largest number of rows that a generator of the plan has made."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    return max([*own, *[most_generated(plan.children().apply(k)) for k in range(plan.children().size())]], default=0)


def test_fan_out_holds_few_rows(spark):
    """A row is handed on before more are made than those of one message and block, however many its chunk and its clients make."""
    m = spark.range(4000).selectExpr("id AS event_id", "'t' AS topic", "id AS ts_ms")
    subs = spark.range(3000).selectExpr("id AS client_id", "'t' AS topic", "0L AS from_ms", "9999L AS to_ms")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (delivery.fan_out(m, subs), delivery.fan_out_current(m, subs)):
            one = df.limit(1)
            assert len(one.collect()) == 1
            assert 0 < most_generated(one._jdf.queryExecution().executedPlan()) < 2 * delivery.BLOCK
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_snapshot_builds_no_deliveries(spark, sf_dir, monkeypatch):
    """The snapshot counts deliveries by topic, as their rows grow with messages times subscriptions."""
    want = {r["name"]: r["value"] for r in registry.QUERIES["metrics_snapshot"](spark, sf_dir).collect()}
    assert want["messagesDelivered"] == registry.QUERIES["fanout"](spark, sf_dir).count() > 0
    monkeypatch.setattr(delivery, "fan_out", None)
    assert {r["name"]: r["value"] for r in registry.QUERIES["metrics_snapshot"](spark, sf_dir).collect()} == want


def test_delivery_counts_of_odd_rows(spark):
    messages = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "topic string")
    subscribed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (3, "d"), (4, None)], "client_id long, topic string")
    for m in (messages, messages.where("topic = 'c'")):
        assert delivery.fan_out_count(m, subscribed).first()[0] == delivery.fan_out(m, subscribed).count()


def test_every_query_is_callable():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert all(callable(q) for q in registry.QUERIES.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
