"""Queries that SQL can't express: ordered folds, which tests compare with plain Python, and random samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import folds, state
from tidewire.plans import fixtures as fx
from tidewire.sources.options import StreamOptions

_DEFAULTS = StreamOptions()
#: The parameters in production; tests set smaller ones, which the small fixtures reach the end of.
WINDOW, RING, QUEUE, OFFER_MS = _DEFAULTS.window, _DEFAULTS.replay_capacity, _DEFAULTS.queue_capacity, _DEFAULTS.offer_timeout_ms


def _late(s, d):
    return fx.arrivals(s, d, late=True).withColumn("kind", F.lit("MSG"))


def window_overrun(s, d):
    return folds.apply_fold(_late(s, d), ["origin"], folds.tracker(WINDOW), "event_id long, accepted boolean, overrun boolean, frontier long")


def gap_reset(s, d):
    """Every 500th arrival a gap moves the frontier back by ten or ahead by twenty."""
    a = _late(s, d)
    resets = a.where("event_id % 500 = 3").withColumn("kind", F.lit("RESET")).withColumn("arrival", F.col("arrival") + 1).withColumn("seq", F.col("seq") + F.when(F.col("event_id") % 1000 == 3, -10).otherwise(20))
    return folds.apply_fold(a.unionByName(resets), ["origin"], folds.tracker(WINDOW), "event_id long, accepted boolean, overrun boolean, frontier long", order=("arrival", "kind"))


def strict_order_fold(s, d):
    return folds.apply_fold(_late(s, d), ["origin"], folds.strict_order(WINDOW), "event_id long, seq long, position long")


def _replay_events(s, d):
    m = fx.sequenced(s, d)
    appends = m.select("origin", F.col("event_id").alias("arrival"), F.lit("APPEND").alias("kind"), "seq", (F.col("event_id") * 10).alias("at_ms"))
    acks = m.where("event_id % 20 = 0").select("origin", F.col("event_id").alias("arrival"), F.lit("ACK").alias("kind"), F.col("seq") - 3, (F.col("event_id") * 10 + 5).alias("at_ms")).toDF("origin", "arrival", "kind", "seq", "at_ms")
    end = m.groupBy("origin").agg((F.max("event_id") + 1).alias("arrival"), F.lit("END").alias("kind"), F.lit(0).cast("long").alias("seq"), (F.max("event_id") * 10 + 100000).alias("at_ms"))
    return appends.unionByName(acks).unionByName(end)


REPLAY = "arrival long, seq long, outcome string, depth long"


def replay_drop_gap(s, d):
    return folds.apply_fold(_replay_events(s, d), ["origin"], folds.replay_buffer(RING), REPLAY, order=("at_ms", "arrival"))


def replay_block(s, d):
    return folds.apply_fold(_replay_events(s, d), ["origin"], folds.replay_buffer(RING, "BLOCK", OFFER_MS), REPLAY, order=("at_ms", "arrival"))


def ingest_overflow(s, d):
    m = fx.sequenced(s, d).select("origin", F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 3 == 0, "TAKE").otherwise("PUT").alias("kind"), "seq")
    return folds.apply_fold(m, ["origin"], folds.ingest_queue(QUEUE), REPLAY)


MEMBER = "arrival long, before string, after string, incarnation long, transition string, refuted_with long"


def _without_node(step):
    return lambda state, event: [(r[0], *r[2:]) for r in step(state, event)]


def member_fold(s, d):
    return folds.apply_fold(fx.member_log(s), ["node"], _without_node(folds.membership()), MEMBER)


def self_refute(s, d):
    return folds.apply_fold(fx.member_log(s).where("node = 'n1'"), ["node"], _without_node(folds.membership("n1")), MEMBER)


def member_transitions(s, d):
    return member_fold(s, d).groupBy("transition").agg(F.count(F.lit(1)).alias("n"))


def _queue_events(s, d):
    """Three of four messages are put into their connection's queue, one takes from it."""
    m = fx.messages(s, d)
    events = m.select("conn_id", F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 4 == 0, "TAKE").otherwise("PUT").alias("kind"), F.col("ts_ms").alias("at_ms"))
    end = m.groupBy("conn_id").agg((F.max("event_id") + 1).alias("arrival"), F.lit("END").alias("kind"), F.max("ts_ms").alias("at_ms"))
    return events.unionByName(end)


OUTCOME = "arrival long, outcome string"


def slow_consumers(s, d):
    return folds.apply_fold(_queue_events(s, d), ["conn_id"], folds.bounded_delivery(QUEUE, OFFER_MS, "DISCONNECT_SLOW_CONSUMER"), OUTCOME)


def slow_consumers_drop(s, d):
    return folds.apply_fold(_queue_events(s, d), ["conn_id"], folds.bounded_delivery(QUEUE, OFFER_MS, "DROP_MESSAGE"), OUTCOME)


def slow_consumers_grace(s, d):
    return folds.apply_fold(_queue_events(s, d), ["conn_id"], folds.grace_delivery(QUEUE, OFFER_MS, "DROP_MESSAGE"), OUTCOME)


def probe_sample(s, d):
    """Three helpers for an indirect probe, and the one member that is probed: random, so tests look at counts only."""
    members = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("node"))
    return state.sampled(members, 3, 7).withColumn("role", F.lit("helper")).unionByName(state.sampled(members, 1, 8).withColumn("role", F.lit("target")))


QUERIES = {f.__name__: f for f in (window_overrun, gap_reset, strict_order_fold, replay_drop_gap, replay_block, ingest_overflow, member_fold, self_refute, member_transitions, slow_consumers, slow_consumers_drop, slow_consumers_grace, probe_sample)}
