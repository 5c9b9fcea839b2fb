"""Folds of interest and membership that windows can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interest_edges(events: DataFrame) -> DataFrame:
    """Topics that get their first subscriber (ADD) or lose their last (REMOVE), with the version of each edge.

    events: node, topic, at_ms, change (1 subscribes, -1 leaves).
    """
    w = Window.partitionBy("node", "topic").orderBy("at_ms", "change").rowsBetween(Window.unboundedPreceding, 0)
    held = events.groupBy("node", "topic", "at_ms", "change").agg(F.count(F.lit(1)).alias("_k"))
    held = held.withColumn("_n", F.sum(F.col("change") * F.col("_k")).over(w)).withColumn("_before", F.col("_n") - F.col("change") * F.col("_k"))
    op = F.when((F.col("_before") <= 0) & (F.col("_n") > 0), "ADD").when((F.col("_before") > 0) & (F.col("_n") <= 0), "REMOVE")
    edges = held.withColumn("op", op).where("op is not null").select("node", "topic", "at_ms", "op")
    return edges.withColumn("version", F.row_number().over(Window.partitionBy("node").orderBy("at_ms", "topic", "op")).cast("long"))


def accepted_updates(log: DataFrame) -> DataFrame:
    """Interest updates whose version is above all before them of that node; a removal of the node starts anew."""
    order = Window.partitionBy("node").orderBy("arrival")
    scoped = log.withColumn("scope", F.sum(F.when(F.col("kind") == "GONE", 1).otherwise(0)).over(order))
    before = F.max(F.when(F.col("kind") != "GONE", F.col("version"))).over(Window.partitionBy("node", "scope").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return scoped.withColumn("_top", before).where((F.col("kind") != "GONE") & (F.col("_top").isNull() | (F.col("version") > F.col("_top")))).drop("_top")


def folded_interest(log: DataFrame) -> DataFrame:
    """(node, topic) that hold at the end: the last accepted full state and the accepted deltas after it."""
    last_scope = log.groupBy("node").agg(F.sum(F.when(F.col("kind") == "GONE", 1).otherwise(0)).alias("scope"))
    updates = accepted_updates(log).join(last_scope, ["node", "scope"])
    synced = F.max(F.when(F.col("kind") == "SYNC", F.col("arrival"))).over(Window.partitionBy("node"))
    current = updates.withColumn("_sync", F.coalesce(synced, F.lit(-1))).where(F.col("arrival") >= F.col("_sync"))
    full = current.where("kind = 'SYNC'").select("node", "arrival", F.lit("ADD").alias("op"), F.explode("topics").alias("topic"))
    deltas = current.where("kind = 'DELTA'").select("node", "arrival", "op", "topic")
    last = Window.partitionBy("node", "topic").orderBy(F.desc("arrival"))
    return full.unionByName(deltas).withColumn("_r", F.row_number().over(last)).where("_r = 1 and op = 'ADD'").select("node", "topic")


def replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a full state changes: (node, topic, op)."""
    return after.join(before, ["node", "topic"], "left_anti").withColumn("op", F.lit("ADD")).unionByName(before.join(after, ["node", "topic"], "left_anti").withColumn("op", F.lit("REMOVE")))


def member_counts(members: DataFrame) -> DataFrame:
    """Members by state; those that left count as dead."""
    return members.groupBy(F.when(F.col("state").isin("DEAD", "LEFT"), "dead").otherwise(F.lower("state")).alias("state")).agg(F.count(F.lit(1)).alias("members"))


def reaped(members: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Dead or left members whose state is at least timeout_ms old."""
    return members.where(F.col("state").isin("DEAD", "LEFT") & (now_ms - F.col("changed_ms") >= timeout_ms))


def expired_suspects(members: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Members with suspects turned dead after timeout_ms."""
    over = (F.col("state") == "SUSPECT") & (now_ms - F.col("changed_ms") >= timeout_ms)
    return members.withColumns({"changed_ms": F.when(over, now_ms).otherwise(F.col("changed_ms")).cast("long"), "state": F.when(over, "DEAD").otherwise(F.col("state"))})


def unanswered(pings: DataFrame, acks: DataFrame, timeout_ms: int) -> DataFrame:
    """Probes without an answer, direct or relayed, within timeout_ms: their targets become suspects."""
    answer = acks.select("target", "probe", F.col("at_ms").alias("_ack"))
    answered = pings.join(answer, ["target", "probe"]).where((F.col("_ack") >= F.col("at_ms")) & (F.col("_ack") <= F.col("at_ms") + timeout_ms)).select("target", "probe").distinct()
    return pings.join(answered, ["target", "probe"], "left_anti")


def expired_targets(last_link: DataFrame, now_ms: int, expiry_ms: int) -> DataFrame:
    """Targets without a link for expiry_ms: their buffer, interest and trackers are freed."""
    return last_link.where(now_ms - F.col("last_ms") >= expiry_ms)


def least_sent(facts: DataFrame, fanout: int, by: str) -> DataFrame:
    """Per sender the facts that were sent least, earlier ones first."""
    w = Window.partitionBy(by).orderBy("sent", "inserted")
    return facts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fanout).drop("_r")


def sampled(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """k random rows; the same for one seed and one layout of the rows."""
    return rows.orderBy(F.rand(seed)).limit(k)
