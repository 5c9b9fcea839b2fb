"""Counters, gauges, percentiles, rates, snapshots and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed names of the metrics, in the order of the snapshot.
NODE_METRICS = (
    "messagesPublished", "messagesDelivered", "droppedMessages", "slowConsumerDisconnects", "totalConnectionsAccepted", "connectionsRejected",
    "activeConnections", "subscriptionCount", "maxOutboundQueueDepth",
)
CLUSTER_METRICS = (
    "messagesForwarded", "messagesReceived", "messagesDeduped", "messagesDropped", "handshakeAuthFailures", "activePeerLinks", "replayBufferDepth",
    "backfillMessages", "gapEvents", "slowPeerStalls", "acksSent", "acksReceived", "interestUpdatesSent", "interestUpdatesReceived",
    "interestRoutedSkipped", "routingTableTopicCount", "membersAlive", "membersSuspect", "membersDead", "joinEvents", "leaveEvents", "suspectEvents",
    "deadEvents", "indirectProbesSent", "gossipMessagesSent", "gossipMessagesReceived", "incarnationConflicts",
)


#: Fixed kinds of the event log and the fields of each, in their order.
EVENT_FIELDS = {
    "join": ("nodeId", "incarnation", "host", "port"),
    "leave": ("nodeId", "incarnation"),
    "peer-connected": ("nodeId", "host", "port"),
    "peer-disconnected": ("nodeId",),
    "backfill-completed": ("nodeId", "messages", "fromLinkSeq"),
    "reaped": ("nodeId",),
    "suspect": ("nodeId", "incarnation"),
    "reconnect": ("nodeId", "host", "port", "backoffMs"),
    "heartbeat-timeout": ("nodeId",),
    "queue-full": ("nodeId", "dropped"),
    "handshake-auth-failure": ("remote",),
    "refute": ("refutedState", "newIncarnation"),
    "gap": ("nodeId", "firstAvailableSeq"),
    "dead": ("nodeId", "incarnation"),
    "data-loss": ("nodeId", "resyncContiguousLinkSeq"),
}


def names() -> tuple[str, ...]:
    """All names of the flat snapshot; those of the cluster have a prefix."""
    return (*NODE_METRICS, *(f"cluster_{n}" for n in CLUSTER_METRICS))


def snapshot(found: DataFrame) -> DataFrame:
    """(name, value) of every metric from those that were found; nothing found is 0, other names are left out."""
    every = found.sparkSession.createDataFrame([(n,) for n in names()], "name string")
    return every.join(found.groupBy("name").agg(F.sum("value").alias("value")), "name", "left").select("name", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def event_lines(events: DataFrame, fields: dict[str, tuple[str, ...]] = EVENT_FIELDS) -> DataFrame:
    """key=value lines of events of known kinds, each with the fields of its kind only; fields that are null are left out."""
    line = F.lit(None).cast("string")
    for kind, own in fields.items():
        parts = [F.lit(f"event={kind}"), *(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in own)]
        line = F.when(F.col("event") == kind, F.concat_ws(" ", *parts)).otherwise(line)
    return events.withColumn("line", line).where(F.col("line").isNotNull())


def counters(events: DataFrame, kinds: dict[str, str], by: str | None = None) -> DataFrame:
    """One count per name: rows for which the SQL condition holds."""
    grouped = events.groupBy(by) if by else events.groupBy()
    return grouped.agg(*[F.count(F.when(F.expr(condition), 1)).alias(name) for name, condition in kinds.items()])


def flat(row: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns to rows (name, value)."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS (name, value)")


def prometheus(metrics: DataFrame, prefix: str = "stream_") -> DataFrame:
    """Exposition text of each metric; all are typed as gauges."""
    name = F.concat(F.lit(prefix), F.col("name"))
    return metrics.select("name", F.concat(F.lit("# TYPE "), name, F.lit(" gauge\n"), name, F.lit(" "), F.col("value").cast("string"), F.lit("\n")).alias("text"))


def floored_gauge(events: DataFrame, keys: list[str], order: list[str], change: str) -> DataFrame:
    """A running sum that never falls below 0: the sum less the least sum so far, as far as that is below 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("_sum", F.sum(change).over(w))
    return summed.withColumn("gauge", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).cast("long")).drop("_sum")


def percentiles(samples: DataFrame, value: str, by: str) -> DataFrame:
    """Nearest-rank percentiles and the maximum: exact, by the discrete percentile."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return samples.groupBy(by).agg(disc(0.5).alias("p50"), disc(0.99).alias("p99"), disc(0.999).alias("p999"), F.max(value).alias("max"))


def rate(events: DataFrame, by: str, at: str, from_ms: int, to_ms: int) -> DataFrame:
    """Events per second in a window after the warm-up."""
    return events.where((F.col(at) >= from_ms) & (F.col(at) < to_ms)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 1000.0 / (to_ms - from_ms)).alias("per_second"))


def soak(received: DataFrame, by: str, seq: str) -> DataFrame:
    """unique, duplicates, highest, missing and loss in per cent, of sequences from 0."""
    held = received.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(seq).alias("uniq"), F.max(seq).alias("highest"))
    missing = F.col("highest") + 1 - F.col("uniq")
    return held.select(by, "uniq", (F.col("n") - F.col("uniq")).alias("duplicates"), "highest", missing.alias("missing"), (missing * 100.0 / (F.col("highest") + 1)).alias("loss_pct"))


def subscriber_counts(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("topic").agg(F.countDistinct("client_id").alias("subscribers"))


def routing_snapshot(interest: DataFrame) -> DataFrame:
    """topic and its nodes, sorted and comma-joined."""
    return interest.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("nodes"))


def quiet(events: DataFrame, keys: list[str], at: str, limit_ms: int) -> DataFrame:
    """Silences of at least limit_ms after an event: idle connections."""
    w = Window.partitionBy(*keys).orderBy(at)
    return events.withColumn("_next", F.lead(at).over(w)).where(F.col("_next") - F.col(at) >= limit_ms).select(*keys, F.col(at).alias("since"), (F.col("_next") - F.col(at)).alias("silence"))


def late_beats(events: DataFrame, keys: list[str], at: str, interval_ms: int) -> DataFrame:
    """Beats that come more than three intervals after the one before."""
    w = Window.partitionBy(*keys).orderBy(at)
    return events.withColumn("_before", F.lag(at).over(w)).where(F.col(at) - F.col("_before") > 3 * interval_ms).select(*keys, at, (F.col(at) - F.col("_before")).alias("silence"))
