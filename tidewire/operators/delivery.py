"""Validation, projection, fan-out and routing of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import folds, sequencing

#: A relation is broadcast by hint only when its optimizer size is known to be below this; Spark decides otherwise.
SMALL_BYTES = 8 << 20
#: Fan-out meets chunks of about so many bytes of messages (as the optimizer knows them) with blocks of some so many clients,
#: of which so many lie in one row.
CHUNK_BYTES, BLOCK, BAND = 64 << 10, 256, 64

CLIENT_ARMS = ("auth_request", "subscribe", "publish_inbound")
CLUSTER_ARMS = (
    "hello", "publish", "ack", "resume", "gap", "interest", "interest_sync", "ping", "ping_ack", "ping_req", "join", "join_ack", "leave", "heartbeat",
)


def _plan_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its plan's size is bounded by SMALL_BYTES."""
    return F.broadcast(df) if _plan_bytes(df) <= SMALL_BYTES else df


def valid(messages: DataFrame, token: str) -> DataFrame:
    """Messages with the right token and a topic; the topic is tested as it was sent, so blanks pass."""
    return messages.where((F.col("token") == token) & (F.length("topic_raw") > 0))


def until_rejected(messages: DataFrame, token: str, conn: str = "conn_id", order: str = "event_id") -> DataFrame:
    """Per connection the messages before its first invalid one, which closes it."""
    bad = F.when((F.col("token") == token) & (F.length("topic_raw") > 0), 0).otherwise(1)
    return messages.withColumn("_bad", F.max(bad).over(Window.partitionBy(conn).orderBy(order))).where("_bad = 0").drop("_bad")


def within_size(messages: DataFrame, most: int, column: str = "data") -> DataFrame:
    return messages.where(F.octet_length(column) <= most)


def demultiplex(frames: DataFrame, arms: tuple[str, ...], *, reject: bool) -> DataFrame:
    """Adds `arm`; frames of other kinds are marked "rejected", or dropped where the plane ignores them."""
    known = F.col("kind").isin(*arms)
    return frames.withColumn("arm", F.when(known, F.col("kind")).otherwise("rejected")) if reject else frames.where(known).withColumn("arm", F.col("kind"))


def exchange_token(requests: DataFrame, secret: str, token: str) -> DataFrame:
    """token where the secret is right, else null and accepted = false."""
    good = F.coalesce(F.col("secret") == secret, F.lit(False))
    return requests.withColumn("accepted", good).withColumn("token", F.when(good, token))


def outbound(messages: DataFrame) -> DataFrame:
    """What subscribers get: no token, no sequences."""
    return messages.select("event_id", F.col("topic_raw").alias("topic"), "source", "data")


def _lazily(array):
    """array, for a generator that makes its rows one at a time.

    A compiled generator or join holds a copy of each row it makes of one input row, and as many as all those fused with it
    multiply to. Nothing that calls a higher-order function is compiled.
    """
    return F.filter(array, lambda _: F.lit(True))


def _fan_out(messages: DataFrame, subs: DataFrame, holds=None) -> DataFrame:
    """messages joined with subs (client_id, topic, ...) by topic, where `holds` of the message's ts_ms is true for the subscription.

    The result outgrows both, so its rows come in an order that takes little room: a block of clients meets one message of
    a chunk after the other, which repeats few clients instead of all of a topic's. Chunks are spread over the tasks
    of a shuffle, however few files hold the messages; a window is tested once per message and band of blocks. Only the last
    step, from a message to the clients of a block, is compiled, so a task holds the rows of one message and block.
    """
    if messages.isStreaming or subs.isStreaming:
        joined = messages.join(subs if subs.isStreaming else small(subs), "topic")
        return (joined.where(holds(F.col("ts_ms"))) if holds else joined).select("topic", *[F.col(f"`{c}`") for c in messages.columns if c != "topic"], "client_id")
    same = [c for c in subs.columns if c != "client_id"]
    held = F.count(F.lit(1)).over(Window.partitionBy(*same))
    dealt = subs.withColumn("_block", F.pmod(F.xxhash64("client_id"), F.ceil(held / BLOCK)))
    blocks = dealt.groupBy(*same, "_block").agg(F.collect_list(F.struct("client_id"))["client_id"].alias("_clients"))
    bands = blocks.groupBy(*same, F.floor(F.col("_block") / BAND).alias("_band")).agg(F.collect_list("_clients").alias("_blocks")).drop("_band")
    by = [F.col(f"`{f.name}`") for f in messages.schema.fields if "map<" not in f.dataType.simpleString()]
    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(4 * tasks, min(-(-_plan_bytes(messages) // CHUNK_BYTES), 1 << 20))
    sent = messages.withColumn("_chunk", F.pmod(F.xxhash64(*by), F.lit(chunks))).repartition(tasks, "topic", "_chunk")
    place = {c: f"_{k}" for k, c in enumerate(messages.columns)}
    sent = sent.groupBy("topic", "_chunk").agg(F.collect_list(F.struct(*[F.col(f"`{c}`").alias(p) for c, p in place.items()])).alias("_messages"))
    met = sent.join(small(bands), "topic")
    if holds:
        met = met.withColumn("_messages", F.filter("_messages", lambda m: holds(m[place["ts_ms"]])))
    met = met.select("_messages", F.explode(_lazily("_blocks")).alias("_clients"))
    met = met.select("_clients", F.inline(_lazily("_messages"))).select(*place.values(), F.explode("_clients").alias("client_id"))
    return met.select(*[F.col(place[c]).alias(c) for c in ("topic", *[c for c in messages.columns if c != "topic"])], "client_id")


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per message and subscriber of its topic; a client counts once per topic. All columns of messages are carried."""
    return _fan_out(messages, subscriptions.select("client_id", "topic").distinct())


def fan_out_current(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Fan-out to the subscriptions that hold when the message arrives: from_ms <= ts_ms < to_ms."""
    return _fan_out(messages, subscriptions.select("client_id", "topic", "from_ms", "to_ms").distinct(), lambda ts: (ts >= F.col("from_ms")) & (ts < F.col("to_ms")))


def fan_out_count(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row with `delivered`, the number of rows of `fan_out`, from counts per topic: none of the rows is built."""
    sent = messages.groupBy("topic").agg(F.count(F.lit(1)).alias("_sent"))
    held = subscriptions.select("client_id", "topic").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("_held"))
    return sent.join(held, "topic").agg(F.coalesce(F.sum(F.col("_sent") * F.col("_held")), F.lit(0)).alias("delivered"))


def undeliverable(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return messages.join(small(subscriptions.select("topic").distinct()), "topic", "left_anti")


def route(messages: DataFrame, interest: DataFrame) -> DataFrame:
    """One row per message and other node that wants its topic."""
    return messages.join(small(interest.distinct()), "topic").where(F.col("node") != F.col("origin"))


def routed_skipped(messages: DataFrame, interest: DataFrame, peers: DataFrame) -> DataFrame:
    """Messages and connected other nodes that don't want the topic: each topic's complement, then an equi-join.

    Topics and nodes are joined first, both being few; messages never meet nodes without a key.
    """
    topics = messages.select("topic").distinct()
    lacking = topics.join(peers, F.lit(True)).join(interest.distinct(), ["topic", "node"], "left_anti")
    return messages.join(small(lacking), "topic").where(F.col("node") != F.col("origin"))


def route_with_grace(messages: DataFrame, interest: DataFrame, peers: DataFrame, changes: DataFrame, grace_ms: int) -> DataFrame:
    """Routing, but to all peers up to grace_ms (inclusive) after the publishing node's own interest in the topic changed.

    changes: origin, topic, change_ms.
    """
    wanted = interest.distinct().withColumn("wanted", F.lit(True))
    every = messages.select("topic").distinct().join(peers, F.lit(True)).join(wanted, ["topic", "node"], "left")
    recent = messages.join(small(changes), ["origin", "topic"], "left").join(small(every), "topic")
    in_grace = (F.col("ts_ms") >= F.col("change_ms")) & (F.col("ts_ms") <= F.col("change_ms") + grace_ms)
    return recent.where(F.col("node") != F.col("origin")).where(F.coalesce("wanted", F.lit(False)) | F.coalesce(in_grace, F.lit(False))).drop("wanted", "change_ms")


def link_sequence(routed: DataFrame) -> DataFrame:
    """A dense sequence per sender and target over the rows that are routed."""
    return sequencing.number(routed, ["origin", "node"], ["seq"], "link_seq", sequencing.SPAN)


def peer_snapshot(links: DataFrame, frontiers: DataFrame, depths: DataFrame) -> DataFrame:
    """Per connected peer its frontier and buffer depth, 0 where unknown."""
    return links.join(frontiers, "node", "left").join(depths, "node", "left").select("node", F.coalesce("frontier", F.lit(0)).cast("long").alias("frontier"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def admitted(events: DataFrame, limit: int) -> DataFrame:
    """Each OPEN of (listener, conn_id, at_ms, kind) with the number of active connections and if it is admitted (limit 0: all are).

    What is rejected is never active, so each decision depends on those before it: an ordered fold per listener.
    """
    return folds.apply_fold(events, ["listener"], folds.admission(limit), "conn_id string, at_ms long, active long, admitted boolean", order=("at_ms", "conn_id", "kind"))
