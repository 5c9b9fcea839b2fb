"""Message-stream fixtures over the test tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.columns import normalize_topic

EPOCH = 1718900000000
TOKEN = "tok"
TOPICS = ("click", "error", "purchase", "signup", "view")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishes: event_id, ts_ms, conn_id, origin, epoch, seq (dense per origin), topic_raw, topic, source, token, data, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    base = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), base, F.lit(" "))).otherwise(base)
    raw = F.when(F.col("event_id") % 211 == 0, "").when(F.col("event_id") % 223 == 0, "  ").otherwise(base)
    out = e.select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("conn_id"),
        F.concat(F.lit("node-"), (F.col("user_id") % 3 + 1).cast("string")).alias("origin"),
        F.lit(EPOCH).alias("epoch"),
        raw.alias("topic_raw"),
        normalize_topic(raw).alias("topic"),
        F.col("user_id").cast("string").alias("source"),
        F.when(F.col("event_id") % 101 == 0, "WRONG").otherwise(TOKEN).alias("token"),
        F.col("props").alias("data"),
        F.col("user_id"),
    )
    return out


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.operators.sequencing import SPAN, number

    return number(messages(spark, sf_dir), ["origin", "epoch"], ["event_id"], "seq", SPAN)


def arrivals(spark: SparkSession, sf_dir: str, *, late: bool = False) -> DataFrame:
    """Sequenced messages with losses and copies, in the order of `arrival`."""
    m = sequenced(spark, sf_dir).where("event_id % 97 <> 0")
    delay = F.when(F.col("event_id") % 50 == 7, 200000).otherwise(0) if late else F.lit(0)
    first = m.withColumn("arrival", F.col("event_id") * 10 + delay)
    copies = m.where("event_id % 10 = 0").withColumn("arrival", F.col("event_id") * 10 + 505)
    return first.unionByName(copies)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, topic_raw, topic, from_ms, to_ms; every tenth row twice."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    topic = F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    start = F.lit(1704067200000) + (F.col("s_suppkey") % 20) * 86400000
    one = s.select(F.col("s_suppkey").alias("client_id"), F.initcap(topic).alias("topic_raw"), topic.alias("topic"), start.alias("from_ms"), (start + 7 * 86400000).alias("to_ms"))
    return one.unionByName(one.where("client_id % 10 = 0"))


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, node: which nodes want a topic."""
    return spark.sql(f"WITH {INTEREST} SELECT topic, node FROM interest")


MESSAGES = f"""raw_messages AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, 'c' || CAST(user_id % 20 AS VARCHAR) AS conn_id, 'node-' || CAST(user_id % 3 + 1 AS VARCHAR) AS origin,
    CAST({EPOCH} AS BIGINT) AS epoch,
    CASE WHEN event_id % 211 = 0 THEN '' WHEN event_id % 223 = 0 THEN '  '
      WHEN event_id % 3 = 0 THEN ' ' || CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' '
      WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS topic_raw,
    CAST(user_id AS VARCHAR) AS source, CASE WHEN event_id % 101 = 0 THEN 'WRONG' ELSE '{TOKEN}' END AS token, props AS data, user_id FROM events),
messages AS (SELECT *, lower(trim(topic_raw)) AS topic FROM raw_messages),
sequenced AS (SELECT *, row_number() OVER (PARTITION BY origin, epoch ORDER BY event_id) AS seq FROM messages)"""
ARRIVALS = MESSAGES + """,
arrivals AS (SELECT *, event_id * 10 AS arrival FROM sequenced WHERE event_id % 97 <> 0
  UNION ALL SELECT *, event_id * 10 + 505 FROM sequenced WHERE event_id % 97 <> 0 AND event_id % 10 = 0)"""
LATE = MESSAGES + """,
arrivals AS (SELECT *, event_id * 10 + CASE WHEN event_id % 50 = 7 THEN 200000 ELSE 0 END AS arrival FROM sequenced WHERE event_id % 97 <> 0
  UNION ALL SELECT *, event_id * 10 + 505 FROM sequenced WHERE event_id % 97 <> 0 AND event_id % 10 = 0)"""
SUBSCRIPTIONS = f"""one AS (SELECT s_suppkey AS client_id, {list(TOPICS)}[1 + s_suppkey % 5] AS topic, 1704067200000 + (s_suppkey % 20) * 86400000 AS from_ms FROM supplier),
subscriptions AS (SELECT client_id, upper(topic[1]) || topic[2:] AS topic_raw, topic, from_ms, from_ms + 7 * 86400000 AS to_ms FROM one
  UNION ALL SELECT client_id, upper(topic[1]) || topic[2:], topic, from_ms, from_ms + 7 * 86400000 FROM one WHERE client_id % 10 = 0)"""
INTEREST = "interest(topic, node) AS (VALUES " + ", ".join(f"('{t}', 'node-{n}')" for i, t in enumerate(TOPICS) for n in (1, 2, 3) if (i + n) % 3 != 0) + ")"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    one = lambda x: "NULL" if x is None else repr(x) if isinstance(x, (int, str)) else str(list(x))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


#: arrival, node, version, kind, op, topic, topics: deltas and full states, with stale, equal and removed versions.
INTEREST_LOG = [
    (1, "A", 5, "DELTA", "ADD", "orders", None),
    (2, "A", 3, "DELTA", "REMOVE", "orders", None),
    (3, "A", 5, "DELTA", "REMOVE", "orders", None),
    (4, "B", 1, "SYNC", None, None, ("a", "b", "c")),
    (5, "B", 2, "SYNC", None, None, ("b", "d")),
    (6, "C", 10, "SYNC", None, None, ("x",)),
    (7, "C", 4, "SYNC", None, None, ("y", "z")),
    (8, "A", 6, "DELTA", "REMOVE", "orders", None),
    (9, "A", 7, "DELTA", "ADD", "orders.eu", None),
    (10, "B", 3, "DELTA", "ADD", "e", None),
    (11, "B", 3, "SYNC", None, None, ("only",)),
    (12, "D", 2, "DELTA", "ADD", "gone", None),
    (13, "D", 0, "GONE", None, None, None),
    (14, "D", 1, "DELTA", "ADD", "back", None),
    (15, "B", 4, "DELTA", "REMOVE", "b", None),
    (16, "C", 11, "DELTA", "ADD", "y", None),
]
INTEREST_COLUMNS = "arrival, node, version, kind, op, topic, topics"

#: arrival, node, state, incarnation, at_ms
MEMBER_LOG = [
    (1, "n1", "ALIVE", 100, 1000),
    (2, "n1", "SUSPECT", 100, 1100),
    (3, "n1", "ALIVE", 100, 1200),
    (4, "n2", "ALIVE", 100, 1000),
    (5, "n2", "DEAD", 100, 1100),
    (6, "n2", "ALIVE", 100, 1200),
    (7, "n2", "SUSPECT", 200, 1300),
    (8, "n2", "ALIVE", 101, 1400),
    (9, "n3", "ALIVE", 100, 1000),
    (10, "n3", "SUSPECT", 100, 1100),
    (11, "n3", "DEAD", 100, 1200),
    (12, "n3", "ALIVE", 101, 1300),
    (13, "n3", "LEFT", 102, 1400),
    (14, "n3", "SUSPECT", 102, 1500),
    (15, "n4", "ALIVE", 50, 1000),
    (16, "n4", "ALIVE", 200, 1050),
    (17, "n4", "LEFT", 10, 1100),
    (18, "n5", "strange", 1, 1000),
    (19, "n6", "DEAD", 7, 900),
    (20, "n1", "DEAD", 101, 1600),
]
MEMBER_COLUMNS = "arrival, node, state, incarnation, at_ms"

def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in rows], schema)


def interest_log(spark: SparkSession) -> DataFrame:
    return literal(spark, INTEREST_LOG, "arrival long, node string, version long, kind string, op string, topic string, topics array<string>")


def member_log(spark: SparkSession) -> DataFrame:
    return literal(spark, MEMBER_LOG, "arrival long, node string, state string, incarnation long, at_ms long")
