"""Queries that SQL can express, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import columns as c
from tidewire.operators import delivery, metrics, sequencing, state
from tidewire.plans import fixtures as fx
from tidewire.plans.fixtures import ARRIVALS, INTEREST, MESSAGES, SUBSCRIPTIONS, TOKEN
from tidewire.sources import cluster, formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VALID = f"valid AS (SELECT * FROM messages WHERE token = '{TOKEN}' AND topic_raw <> '')"
MAX_DATA = 28


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def valid(s: SparkSession, d: str) -> DataFrame:
    return delivery.valid(fx.messages(s, d), TOKEN)


def peers(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(f"node-{n}",) for n in (1, 2, 3)], "node string")


PEERS = "peers(node) AS (VALUES ('node-1'), ('node-2'), ('node-3'))"


# --- topics, validation, projection, dispatch


@query(f"WITH {MESSAGES} SELECT event_id, topic_raw, topic FROM messages")
def normalize_topic(s, d):
    return fx.messages(s, d).select("event_id", "topic_raw", "topic")


@query(f"WITH {MESSAGES}, {VALID} SELECT event_id, topic_raw FROM valid")
def reject_invalid(s, d):
    return valid(s, d).select("event_id", "topic_raw")


@query(f"WITH {MESSAGES} SELECT event_id, conn_id FROM (SELECT *, max(CASE WHEN token = '{TOKEN}' AND topic_raw <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY conn_id ORDER BY event_id) AS bad FROM messages) WHERE bad = 0")
def close_on_bad_frame(s, d):
    return delivery.until_rejected(fx.messages(s, d), TOKEN).select("event_id", "conn_id")


@query(f"WITH {MESSAGES} SELECT event_id, strlen(data) AS size FROM messages WHERE strlen(data) <= {MAX_DATA}")
def frame_size(s, d):
    return delivery.within_size(fx.messages(s, d), MAX_DATA).select("event_id", F.octet_length("data").cast("long").alias("size"))


def _varint(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END)"


def _field(x: str) -> str:
    return f"(CASE WHEN strlen({x}) = 0 THEN 0 ELSE 1 + {_varint(f'strlen({x})')} + strlen({x}) END)"


@query(f"WITH {MESSAGES}, i AS (SELECT event_id, CAST({_field('topic_raw')} + {_field('source')} + {_field('data')} AS BIGINT) AS n FROM messages) SELECT event_id, 1 + {_varint('n')} + n AS size FROM i")
def wire_size(s, d):
    return fx.messages(s, d).select("event_id", c.publish_size(F.col("topic_raw"), F.col("source"), F.col("data")).alias("size"))


KIND = "CASE event_id % 5 WHEN 0 THEN 'auth_request' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'publish_inbound' WHEN 3 THEN 'publish_outbound' ELSE 'gap' END"


@query(f"WITH k AS (SELECT event_id, {KIND} AS kind FROM events) SELECT event_id, kind, CASE WHEN kind IN ('auth_request', 'subscribe', 'publish_inbound') THEN kind ELSE 'rejected' END AS arm FROM k")
def demux_client(s, d):
    return delivery.demultiplex(fx.messages(s, d).select("event_id", F.expr(KIND).alias("kind")), delivery.CLIENT_ARMS, reject=True)


CLUSTER_KINDS_SENT = ("hello", "publish", "ack", "resume", "gap", "interest", "interest_sync", "ping", "ping_ack", "ping_req", "join", "join_ack", "leave", "heartbeat", "subscribe", "later_kind")


@query(f"WITH k AS (SELECT event_id, {list(CLUSTER_KINDS_SENT)}[1 + event_id % 16] AS kind FROM events) SELECT event_id, kind, kind AS arm FROM k WHERE kind NOT IN ('subscribe', 'later_kind')")
def demux_cluster(s, d):
    kind = F.element_at(F.array(*map(F.lit, CLUSTER_KINDS_SENT)), (F.col("event_id") % 16 + 1).cast("int"))
    return delivery.demultiplex(fx.messages(s, d).select("event_id", kind.alias("kind")), delivery.CLUSTER_ARMS, reject=False)


@query("WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN NULL ELSE 'key' END AS secret FROM events) SELECT event_id, secret, coalesce(secret = 'key', false) AS accepted, CASE WHEN secret = 'key' THEN 'tok' END AS token FROM r")
def token_exchange(s, d):
    secret = F.when(F.col("event_id") % 7 == 0, "bad").when(F.col("event_id") % 11 == 0, None).otherwise("key")
    return delivery.exchange_token(fx.messages(s, d).select("event_id", secret.alias("secret")), "key", TOKEN)


@query(f"WITH {MESSAGES}, {VALID} SELECT event_id, topic_raw AS topic, source, data FROM valid")
def project_outbound(s, d):
    return delivery.outbound(valid(s, d))


@query(f"WITH {MESSAGES} SELECT event_id, topic, source, data FROM sequenced")
def project_cluster(s, d):
    return fx.sequenced(s, d).select("event_id", "topic", "source", "data")


@query(f"WITH {MESSAGES} SELECT event_id, topic FROM messages WHERE topic IN ('click', 'view')")
def known_topics_only(s, d):
    registered = s.createDataFrame([("click",), ("view",)], "topic string")
    return fx.messages(s, d).join(delivery.small(registered), "topic").select("event_id", "topic")


@query("WITH e AS (SELECT event_id, 'auth_request' AS kind, 'key' AS secret, NULL AS topic FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'subscribe', NULL, event_type FROM events WHERE event_id % 2 = 1) SELECT event_id, kind, to_json(CASE WHEN kind = 'subscribe' THEN {'topic': topic} END)::VARCHAR AS subscribe FROM e")
def envelopes(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    even = F.col("event_id") % 2 == 0
    kind = F.when(even, "auth_request").otherwise("subscribe")
    return e.select("event_id", kind.alias("kind"), F.when(~even, c.json_row(F.col("event_type").alias("topic"))).alias("subscribe"))


MOST_ACTIVE = 6
ADMIT = """RECURSIVE log AS (SELECT user_id % 8 AS listener, 'u' || CAST(user_id AS VARCHAR) AS conn_id, event_id AS at_ms, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'OPEN' ELSE 'CLOSE' END AS kind,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
held AS (SELECT DISTINCT listener, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS conns, CAST(NULL AS VARCHAR) AS conn_id, CAST(NULL AS BIGINT) AS at_ms, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS active FROM log
  UNION ALL SELECT l.listener, l.n, CASE WHEN l.kind = 'OPEN' AND len(conns) < 6 THEN list_append(conns, l.conn_id)
    WHEN l.kind = 'CLOSE' AND list_contains(conns, l.conn_id) THEN list_concat(conns[:list_position(conns, l.conn_id) - 1], conns[list_position(conns, l.conn_id) + 1:]) ELSE conns END,
    l.conn_id, l.at_ms, l.kind, CAST(len(conns) + 1 AS BIGINT) FROM held h JOIN log l ON l.listener = h.listener AND l.n = h.n + 1)"""


@query(f"WITH {ADMIT} SELECT listener, conn_id, at_ms, active, active <= {MOST_ACTIVE} AS admitted FROM held WHERE kind = 'OPEN'")
def admission(s, d):
    """Every event opens or closes a connection of its user; many opens are rejected, and some of those are closed."""
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "OPEN").otherwise("CLOSE")
    log = e.select((F.col("user_id") % 8).alias("listener"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("conn_id"), F.col("event_id").alias("at_ms"), kind.alias("kind"))
    return delivery.admitted(log, MOST_ACTIVE)


# --- fan-out and routing


@query(f"WITH {MESSAGES}, {VALID}, {SUBSCRIPTIONS} SELECT m.event_id, s.client_id, m.topic_raw, m.source FROM valid m JOIN (SELECT DISTINCT client_id, topic FROM subscriptions) s ON m.topic = s.topic")
def fanout(s, d):
    sent = valid(s, d).select("event_id", "topic", "topic_raw", "source")
    return delivery.fan_out(sent, fx.subscriptions(s, d)).select("event_id", "client_id", "topic_raw", "source")


@query(f"WITH {MESSAGES}, {VALID}, {SUBSCRIPTIONS} SELECT m.event_id, s.client_id FROM valid m JOIN (SELECT DISTINCT client_id, topic, from_ms, to_ms FROM subscriptions) s ON m.topic = s.topic AND m.ts_ms >= s.from_ms AND m.ts_ms < s.to_ms")
def fanout_temporal(s, d):
    return delivery.fan_out_current(valid(s, d).select("event_id", "topic", "ts_ms"), fx.subscriptions(s, d)).select("event_id", "client_id")


@query(f"WITH {MESSAGES}, {SUBSCRIPTIONS} SELECT event_id, topic FROM messages WHERE topic NOT IN (SELECT topic FROM subscriptions)")
def undeliverable(s, d):
    return delivery.undeliverable(fx.messages(s, d), fx.subscriptions(s, d)).select("event_id", "topic")


@query(f"WITH {MESSAGES}, {INTEREST} SELECT event_id, origin, node, topic FROM messages JOIN interest USING (topic) WHERE node <> origin")
def route_interest(s, d):
    return delivery.route(fx.messages(s, d), fx.interest(s, d)).select("event_id", "origin", "node", "topic")


@query(f"WITH {MESSAGES}, {INTEREST}, {PEERS} SELECT event_id, node FROM messages m, peers p WHERE node <> origin AND NOT EXISTS (SELECT 1 FROM interest i WHERE i.topic = m.topic AND i.node = p.node)")
def routed_skipped(s, d):
    return delivery.routed_skipped(fx.messages(s, d), fx.interest(s, d), peers(s)).select("event_id", "node")


CHANGES = [("node-1", "click", 1704100000000), ("node-2", "view", 1705000000000), ("node-3", "error", 1706000000000)]
GRACE = 86400000


@query(f"WITH {MESSAGES}, {INTEREST}, {PEERS}, {fx.values('changes', 'origin, topic, change_ms', CHANGES)} SELECT m.event_id, p.node FROM messages m CROSS JOIN peers p LEFT JOIN interest i ON i.topic = m.topic AND i.node = p.node LEFT JOIN changes c ON c.origin = m.origin AND c.topic = m.topic WHERE p.node <> m.origin AND (i.node IS NOT NULL OR (m.ts_ms >= c.change_ms AND m.ts_ms <= c.change_ms + {GRACE}))")
def broadcast_grace(s, d):
    changes = fx.literal(s, CHANGES, "origin string, topic string, change_ms long")
    return delivery.route_with_grace(fx.messages(s, d), fx.interest(s, d), peers(s), changes, GRACE).select("event_id", "node")


LINKS = f"{MESSAGES}, {INTEREST}, links AS (SELECT event_id, origin, node, seq, row_number() OVER (PARTITION BY origin, node ORDER BY seq) AS link_seq FROM sequenced JOIN interest USING (topic) WHERE node <> origin)"


@query(f"WITH {LINKS} SELECT event_id, origin, node, link_seq FROM links")
def link_seq(s, d):
    return delivery.link_sequence(delivery.route(fx.sequenced(s, d), fx.interest(s, d))).select("event_id", "origin", "node", "link_seq")


@query(f"WITH {ARRIVALS}, {PEERS}, i AS (SELECT origin, seq, row_number() OVER (PARTITION BY origin ORDER BY seq) AS n FROM (SELECT DISTINCT origin, seq FROM arrivals)), f AS (SELECT origin AS node, max(CASE WHEN seq = n THEN seq END) AS frontier FROM i WHERE origin <> 'node-3' GROUP BY 1), q AS (SELECT origin AS node, count(*) AS depth FROM arrivals WHERE origin <> 'node-1' GROUP BY 1) SELECT node, coalesce(frontier, 0) AS frontier, coalesce(depth, 0) AS depth FROM peers LEFT JOIN f USING (node) LEFT JOIN q USING (node)")
def peer_snapshot(s, d):
    a = fx.arrivals(s, d)
    f = sequencing.frontiers(a.where("origin <> 'node-3'"), ["origin"]).withColumnRenamed("origin", "node")
    q = a.where("origin <> 'node-1'").groupBy(F.col("origin").alias("node")).agg(F.count(F.lit(1)).alias("depth"))
    return delivery.peer_snapshot(peers(s), f, q)


@query(f"WITH {MESSAGES}, {VALID}, {SUBSCRIPTIONS}, {INTEREST} SELECT event_id, 'local' AS plane, topic_raw AS topic, CAST(client_id AS VARCHAR) AS receiver FROM valid JOIN (SELECT DISTINCT client_id, topic FROM subscriptions) USING (topic) UNION ALL SELECT event_id, 'remote', topic, node FROM valid JOIN interest USING (topic) WHERE node <> origin")
def all_deliveries(s, d):
    v = valid(s, d)
    held = fx.subscriptions(s, d).withColumn("client_id", F.col("client_id").cast("string"))
    local = delivery.fan_out(v.select("event_id", "topic", "topic_raw"), held).select("event_id", F.lit("local").alias("plane"), F.col("topic_raw").alias("topic"), F.col("client_id").alias("receiver"))
    remote = delivery.route(v, fx.interest(s, d)).select("event_id", F.lit("remote").alias("plane"), "topic", F.col("node").alias("receiver"))
    return local.unionByName(remote)


# --- sequences


@query(f"WITH {MESSAGES} SELECT event_id, origin, epoch, seq FROM sequenced")
def origin_seq(s, d):
    return fx.sequenced(s, d).select("event_id", "origin", "epoch", "seq")


FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, epoch, seq ORDER BY arrival) AS copy FROM arrivals) WHERE copy = 1)"


@query(f"WITH {ARRIVALS}, {FIRST} SELECT event_id, origin, seq, arrival FROM first")
def dedup_logical(s, d):
    return sequencing.deduplicate(fx.arrivals(s, d), ["origin", "epoch", "seq"]).select("event_id", "origin", "seq", "arrival")


def _wire_arrivals(s, d):
    links = delivery.link_sequence(delivery.route(fx.sequenced(s, d), fx.interest(s, d))).withColumn("arrival", F.col("event_id") * 10)
    return links.unionByName(links.where("event_id % 10 = 0").withColumn("arrival", F.col("event_id") * 10 + 505))


WIRE = LINKS + ", wire AS (SELECT *, event_id * 10 AS arrival FROM links UNION ALL SELECT *, event_id * 10 + 505 FROM links WHERE event_id % 10 = 0), wired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, node, link_seq ORDER BY arrival) AS copy FROM wire) WHERE copy = 1)"


@query(f"WITH {WIRE} SELECT event_id, origin, node, link_seq, arrival FROM wired")
def dedup_wire(s, d):
    return sequencing.deduplicate(_wire_arrivals(s, d), ["origin", "node", "link_seq"]).select("event_id", "origin", "node", "link_seq", "arrival")


@query(f"WITH {WIRE} SELECT event_id, origin, node, arrival FROM (SELECT *, row_number() OVER (PARTITION BY node, origin, seq ORDER BY arrival) AS again FROM wired) WHERE again = 1")
def dedup_two_stage(s, d):
    once = sequencing.deduplicate(_wire_arrivals(s, d), ["origin", "node", "link_seq"])
    return sequencing.deduplicate(once, ["node", "origin", "epoch", "seq"]).select("event_id", "origin", "node", "arrival")


ISLAND = "island AS (SELECT origin, coalesce(max(CASE WHEN seq = n THEN seq END), 0) AS frontier FROM (SELECT origin, seq, row_number() OVER (PARTITION BY origin ORDER BY seq) AS n FROM (SELECT DISTINCT origin, seq FROM arrivals)) GROUP BY origin)"


@query(f"WITH {ARRIVALS}, {ISLAND} SELECT origin, frontier FROM island")
def frontier(s, d):
    return sequencing.frontiers(fx.arrivals(s, d), ["origin"])


@query(f"WITH {ARRIVALS}, n AS (SELECT origin, seq, lead(seq) OVER (PARTITION BY origin ORDER BY seq) AS nxt FROM (SELECT DISTINCT origin, seq FROM arrivals)) SELECT origin, seq + 1 AS gap_from, nxt - 1 AS gap_to FROM n WHERE nxt - seq > 1")
def gaps(s, d):
    return sequencing.gaps(fx.arrivals(s, d), ["origin"])


@query(f"WITH {ARRIVALS}, {FIRST}, {ISLAND} SELECT event_id, f.origin, seq, row_number() OVER (PARTITION BY f.origin ORDER BY seq) AS position FROM first f JOIN island i ON f.origin = i.origin WHERE seq <= frontier")
def strict_order(s, d):
    return sequencing.in_order(fx.arrivals(s, d), ["origin"]).select("event_id", "origin", "seq", "position")


@query(f"WITH {ARRIVALS}, {FIRST} SELECT event_id, origin, row_number() OVER (PARTITION BY origin ORDER BY arrival) AS position FROM first")
def arrival_order(s, d):
    return sequencing.number(sequencing.deduplicate(fx.arrivals(s, d), ["origin", "epoch", "seq"]), ["origin"], ["arrival"], "position", sequencing.SPAN).select("event_id", "origin", "position")


@query(f"WITH {ARRIVALS}, {FIRST}, a AS (SELECT origin, max(seq) AS acked FROM first WHERE event_id % 13 = 0 GROUP BY 1) SELECT f.origin, seq FROM first f LEFT JOIN a ON f.origin = a.origin WHERE seq > coalesce(acked, 0)")
def ack_evict(s, d):
    first = sequencing.deduplicate(fx.arrivals(s, d), ["origin", "epoch", "seq"]).select("origin", "seq", "event_id")
    acks = first.where("event_id % 13 = 0").select("origin", F.col("seq").alias("acked"))
    return sequencing.evict_acked(first, acks, "origin").select("origin", "seq")


RESUMES = [("node-1", 60, 100), ("node-2", 10, 100), ("node-3", 100, 100), ("node-4", 3, 9), ("node-5", 9, 9)]
BUFFER = [(f"node-{n}", q) for n in (1, 2, 3) for q in range(41, 101) if q % 7]


@query(f"WITH {fx.values('buffer', 'node, seq', BUFFER)}, {fx.values('resumes', 'node, last, highest', RESUMES)}, h AS (SELECT r.*, (SELECT min(seq) FROM buffer b WHERE b.node = r.node) AS head FROM resumes r WHERE last < highest), g AS (SELECT *, CASE WHEN head IS NULL THEN highest + 1 WHEN last + 1 < head THEN head END AS gap FROM h) SELECT node, 'gap' AS kind, CAST(gap AS BIGINT) AS seq FROM g WHERE gap IS NOT NULL UNION ALL SELECT g.node, 'entry', CAST(b.seq AS BIGINT) FROM g JOIN buffer b ON g.node = b.node WHERE gap IS NULL AND b.seq > g.last")
def replay_from(s, d):
    return sequencing.replay(fx.literal(s, BUFFER, "node string, seq long"), fx.literal(s, RESUMES, "node string, last long, highest long"), "node")


@query(f"WITH {LINKS}, again AS (SELECT *, event_id * 10 AS arrival FROM links UNION ALL SELECT *, event_id * 10 + 1000000 FROM links WHERE link_seq > 100) SELECT event_id, origin, node, link_seq, min(arrival) AS arrival FROM again GROUP BY ALL")
def backfill(s, d):
    live = delivery.link_sequence(delivery.route(fx.sequenced(s, d), fx.interest(s, d))).withColumn("arrival", F.col("event_id") * 10)
    sent_again = live.where("link_seq > 100").withColumn("arrival", F.col("arrival") + 1000000)
    return sequencing.deduplicate(live.unionByName(sent_again), ["origin", "node", "link_seq"]).select("event_id", "origin", "node", "link_seq", "arrival")


@query(f"WITH {ARRIVALS}, fi AS (SELECT origin, seq, min(arrival) AS first_at FROM arrivals GROUP BY 1, 2), re AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS n FROM fi), rd AS (SELECT origin, seq, max(first_at) OVER (PARTITION BY origin ORDER BY seq) AS ready FROM re WHERE n = seq), fr AS (SELECT a.event_id, a.origin, a.arrival, (SELECT coalesce(max(rd.seq), 0) FROM rd WHERE rd.origin = a.origin AND rd.ready <= a.arrival) AS frontier FROM arrivals a) SELECT event_id, origin, arrival, frontier FROM (SELECT *, coalesce(lag(frontier) OVER (PARTITION BY origin ORDER BY arrival), 0) AS b FROM fr) WHERE frontier > b")
def ack_advanced(s, d):
    running = sequencing.running_frontier(fx.arrivals(s, d), ["origin"])
    return sequencing.advanced(running, ["origin"], "arrival", "frontier").select("event_id", "origin", "arrival", "frontier")


@query(f"WITH {MESSAGES} SELECT event_id, conn_id, CAST(ceil(row_number() OVER (PARTITION BY conn_id ORDER BY event_id) / 64.0) AS BIGINT) AS batch FROM messages")
def write_batches(s, d):
    return sequencing.batches(fx.messages(s, d), ["conn_id"], ["event_id"]).select("event_id", "conn_id", "batch")


# --- interest and membership


def _sub_events(s, d):
    subs = fx.subscriptions(s, d).distinct().withColumn("node", F.concat(F.lit("node-"), (F.col("client_id") % 3 + 1).cast("string")))
    return subs.select("node", "topic", F.col("from_ms").alias("at_ms"), F.lit(1).alias("change")).unionByName(subs.select("node", "topic", F.col("to_ms").alias("at_ms"), F.lit(-1).alias("change")))


EDGES = f"{SUBSCRIPTIONS}, ds AS (SELECT DISTINCT *, 'node-' || CAST(client_id % 3 + 1 AS VARCHAR) AS node FROM subscriptions), ev AS (SELECT node, topic, from_ms AS at_ms, 1 AS change FROM ds UNION ALL SELECT node, topic, to_ms, -1 FROM ds), su AS (SELECT node, topic, at_ms, change, sum(change) AS k FROM ev GROUP BY ALL), ru AS (SELECT *, sum(k) OVER (PARTITION BY node, topic ORDER BY at_ms, change ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM su), edges AS (SELECT node, topic, at_ms, CASE WHEN n - k <= 0 AND n > 0 THEN 'ADD' WHEN n - k > 0 AND n <= 0 THEN 'REMOVE' END AS op FROM ru)"


@query(f"WITH {EDGES} SELECT node, topic, at_ms, op, row_number() OVER (PARTITION BY node ORDER BY at_ms, topic, op) AS version FROM edges WHERE op IS NOT NULL")
def interest_edges(s, d):
    return state.interest_edges(_sub_events(s, d))


LOG = fx.values("log", fx.INTEREST_COLUMNS, fx.INTEREST_LOG)
ACCEPTED = f"{LOG}, sc AS (SELECT *, sum(CASE WHEN kind = 'GONE' THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY arrival) AS scope FROM log), tp AS (SELECT *, max(CASE WHEN kind <> 'GONE' THEN version END) OVER (PARTITION BY node, scope ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sc), ac AS (SELECT * FROM tp WHERE kind <> 'GONE' AND (top IS NULL OR version > top))"


@query(f"WITH {ACCEPTED} SELECT CAST(arrival AS BIGINT) AS arrival, node, CAST(version AS BIGINT) AS version FROM ac")
def interest_accepted(s, d):
    return state.accepted_updates(fx.interest_log(s)).select("arrival", "node", "version")


@query(f"WITH {ACCEPTED}, ls AS (SELECT node, max(scope) AS scope FROM sc GROUP BY 1), cu AS (SELECT ac.*, coalesce(max(CASE WHEN kind = 'SYNC' THEN arrival END) OVER (PARTITION BY node), -1) AS sy FROM ac JOIN ls USING (node, scope)), al AS (SELECT node, arrival, 'ADD' AS op, unnest(topics) AS topic FROM cu WHERE kind = 'SYNC' AND arrival >= sy UNION ALL SELECT node, arrival, op, topic FROM cu WHERE kind = 'DELTA' AND arrival >= sy) SELECT node, topic FROM (SELECT *, row_number() OVER (PARTITION BY node, topic ORDER BY arrival DESC) AS r FROM al) WHERE r = 1 AND op = 'ADD'")
def interest_fold(s, d):
    return state.folded_interest(fx.interest_log(s))


@query("WITH b(node, topic) AS (VALUES ('B', 'a'), ('B', 'b'), ('B', 'c')), a(node, topic) AS (VALUES ('B', 'b'), ('B', 'd')) SELECT *, 'ADD' AS op FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'REMOVE' FROM (FROM b EXCEPT FROM a)")
def interest_replace(s, d):
    return state.replaced(s.createDataFrame([("B", x) for x in "abc"], "node string, topic string"), s.createDataFrame([("B", x) for x in "bd"], "node string, topic string"))


@query(f"WITH {INTEREST} SELECT topic, array_to_string(list_sort(list(DISTINCT node)), ',') AS nodes FROM interest GROUP BY topic")
def routing_snapshot(s, d):
    return metrics.routing_snapshot(fx.interest(s, d))


@query(f"WITH {SUBSCRIPTIONS} SELECT topic, count(DISTINCT client_id) AS subscribers FROM subscriptions GROUP BY topic")
def subscriber_count(s, d):
    return metrics.subscriber_counts(fx.subscriptions(s, d))


MEMBERS = [("n1", "ALIVE", 100), ("n2", "SUSPECT", 400), ("n3", "DEAD", 1000), ("n4", "LEFT", 1000), ("n5", "ALIVE", 900), ("n6", "DEAD", 1600), ("n7", "SUSPECT", 1500)]
MEMBERS_SQL = fx.values("members", "node, state, changed_ms", MEMBERS)


def _members(s):
    return fx.literal(s, MEMBERS, "node string, state string, changed_ms long")


@query(f"WITH {MEMBERS_SQL} SELECT CASE WHEN state IN ('DEAD', 'LEFT') THEN 'dead' ELSE lower(state) END AS state, count(*) AS members FROM members GROUP BY 1")
def member_counts(s, d):
    return state.member_counts(_members(s))


@query(f"WITH {MEMBERS_SQL} SELECT node, state FROM members WHERE state IN ('DEAD', 'LEFT') AND 2000 - changed_ms >= 1000")
def reap_members(s, d):
    return state.reaped(_members(s), 2000, 1000).select("node", "state")


@query(f"WITH {MEMBERS_SQL} SELECT node, CASE WHEN state = 'SUSPECT' AND 2000 - changed_ms >= 1000 THEN 'DEAD' ELSE state END AS state, CAST(CASE WHEN state = 'SUSPECT' AND 2000 - changed_ms >= 1000 THEN 2000 ELSE changed_ms END AS BIGINT) AS changed_ms FROM members")
def suspect_timeout(s, d):
    return state.expired_suspects(_members(s), 2000, 1000).select("node", "state", "changed_ms")


@query("SELECT event_id AS probe, 'n' || CAST(user_id % 9 AS VARCHAR) AS target FROM events WHERE NOT (event_id % 3 <> 0 AND event_id % 700 <= 500)")
def probe_timeouts(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("probe"), F.concat(F.lit("n"), (F.col("user_id") % 9).cast("string")).alias("target"), (F.col("event_id") * 10).alias("at_ms"))
    acks = e.where("probe % 3 <> 0").select("probe", "target", (F.col("at_ms") + F.col("probe") % 700).alias("at_ms"))
    return state.unanswered(e, acks, 500).select("probe", "target")


@query(f"WITH {MESSAGES} SELECT origin, conn_id, max(ts_ms) AS last_ms FROM messages GROUP BY 1, 2 HAVING 1706660000000 - max(ts_ms) >= 2000000")
def target_expiry(s, d):
    last = fx.messages(s, d).groupBy("origin", "conn_id").agg(F.max("ts_ms").alias("last_ms"))
    return state.expired_targets(last, 1706660000000, 2000000)


@query("SELECT node, event_id FROM (SELECT 'n' || CAST(user_id % 7 AS VARCHAR) AS node, event_id, row_number() OVER (PARTITION BY 'n' || CAST(user_id % 7 AS VARCHAR) ORDER BY event_id % 13, event_id) AS r FROM events) WHERE r <= 6")
def gossip_topk(s, d):
    facts = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")).alias("node"), "event_id", (F.col("event_id") % 13).alias("sent"), F.col("event_id").alias("inserted"))
    return state.least_sent(facts, 6, "node").select("node", "event_id")


# --- metrics and text


COUNTED = {"messagesPublished": f"token = '{TOKEN}' AND topic_raw <> ''", "rejectedToken": f"token <> '{TOKEN}'", "rejectedTopic": "topic_raw = ''"}


@query(f"WITH {MESSAGES} SELECT origin, " + ", ".join(f'count(CASE WHEN {v} THEN 1 END) AS "{k}"' for k, v in COUNTED.items()) + " FROM messages GROUP BY origin")
def counters(s, d):
    return metrics.counters(fx.messages(s, d), COUNTED, "origin")


CLUSTER_KINDS = {"cluster_messagesReceived": "true", "cluster_messagesDeduped": "copy > 1", "cluster_messagesForwarded": "copy = 1"}


@query(f"WITH {ARRIVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY origin, epoch, seq ORDER BY arrival) AS copy FROM arrivals) SELECT " + ", ".join(f'count(CASE WHEN {v} THEN 1 END) AS "{k}"' for k, v in CLUSTER_KINDS.items()) + " FROM n")
def cluster_counters(s, d):
    return metrics.counters(sequencing.number(fx.arrivals(s, d), ["origin", "epoch", "seq"], ["arrival"], "copy"), CLUSTER_KINDS)


CHANGE = "CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN -1 ELSE 0 END"


@query(f"WITH {MESSAGES}, r AS (SELECT event_id, conn_id, sum({CHANGE}) OVER (PARTITION BY conn_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM messages) SELECT event_id, conn_id, CAST(s - least(0, min(s) OVER (PARTITION BY conn_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS gauge FROM r")
def active_gauge(s, d):
    return metrics.floored_gauge(fx.messages(s, d).withColumn("change", F.expr(CHANGE)), ["conn_id"], ["event_id"], "change").select("event_id", "conn_id", "gauge")


@query(f"WITH {MESSAGES}, p AS (SELECT conn_id, event_id, sum({CHANGE}) OVER (PARTITION BY conn_id ORDER BY event_id) AS s FROM messages), q AS (SELECT a.conn_id, a.event_id, max(a.s - b.s) AS depth FROM p a JOIN (SELECT * FROM p UNION ALL SELECT DISTINCT conn_id, -1, 0 FROM p) b ON a.conn_id = b.conn_id AND b.event_id <= a.event_id GROUP BY ALL) SELECT conn_id, CAST(max(depth) AS BIGINT) AS deepest FROM q GROUP BY conn_id")
def max_depth(s, d):
    """The deepest that each connection's queue was; a take from an empty queue leaves it empty."""
    depth = metrics.floored_gauge(fx.messages(s, d).withColumn("change", F.expr(CHANGE)), ["conn_id"], ["event_id"], "change")
    return depth.groupBy("conn_id").agg(F.max("gauge").alias("deepest"))


@query(f"WITH {ARRIVALS}, {FIRST} SELECT origin, CAST(sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS depth FROM first GROUP BY origin")
def replay_depth(s, d):
    first = sequencing.deduplicate(fx.arrivals(s, d), ["origin", "epoch", "seq"])
    return first.groupBy("origin").agg(F.sum(F.when(F.col("event_id") % 4 == 0, -1).otherwise(1)).alias("depth"))


NAMES = {"messagesPublished": "count(*)", "messagesDelivered": "count(CASE WHEN topic <> '' THEN 1 END)", "droppedMessages": "count(CASE WHEN topic = '' THEN 1 END)", "activeConnections": "count(DISTINCT conn_id)", "maxOutboundQueueDepth": "max(octet_length(data))"}
FLAT = f"WITH {MESSAGES}, x AS (SELECT " + ", ".join(f'CAST({v.replace("octet_length", "strlen")} AS BIGINT) AS "{k}"' for k, v in NAMES.items()) + " FROM messages), flat AS (UNPIVOT x ON COLUMNS(*) INTO NAME name VALUE value)"


def _flat(s, d):
    row = fx.messages(s, d).agg(*[F.expr(f"cast({v} as bigint)").alias(k) for k, v in NAMES.items()])
    return metrics.flat(row, tuple(NAMES))


@query(f"{FLAT} SELECT name, value FROM flat")
def metrics_flat(s, d):
    return _flat(s, d)


@query(f"{FLAT} SELECT name, '# TYPE stream_' || name || ' gauge' || chr(10) || 'stream_' || name || ' ' || CAST(value AS VARCHAR) || chr(10) AS text FROM flat")
def prometheus_text(s, d):
    return metrics.prometheus(_flat(s, d))


@query(f"{FLAT} SELECT to_json({{'name': name, 'value': value}})::VARCHAR AS json FROM flat")
def metrics_json(s, d):
    return _flat(s, d).select(c.json_row(F.col("name"), F.col("value")).alias("json"))


EVENT_VALUES = {"nodeId": "'n' || CAST(user_id % 9 AS VARCHAR)", "incarnation": "event_id", "host": "'h' || CAST(user_id AS VARCHAR)", "port": "7000 + user_id % 9", "messages": "event_id % 100", "fromLinkSeq": "event_id + 1", "backoffMs": "250", "dropped": "event_type", "remote": "'r' || CAST(user_id AS VARCHAR)", "refutedState": "'SUSPECT'", "newIncarnation": "event_id + 2", "firstAvailableSeq": "CASE WHEN event_id % 2 = 0 THEN event_id END", "resyncContiguousLinkSeq": "event_id - 1"}
EVENT_KINDS = [*metrics.EVENT_FIELDS, "unknown"]


@query(f"WITH e AS (SELECT event_id, {EVENT_KINDS}[1 + event_id % {len(EVENT_KINDS)}] AS event, {', '.join(f'{v} AS {k}' for k, v in EVENT_VALUES.items())} FROM events), "
       "f AS (SELECT event_id, event, unnest([0, 1, 2, 3]) AS i FROM e), p AS (SELECT e.event_id, e.event, i, CASE " + " ".join(f"WHEN e.event = '{kind}' AND i = {i} THEN '{x}=' || CAST({x} AS VARCHAR)" for kind, own in metrics.EVENT_FIELDS.items() for i, x in enumerate(own)) + " END AS x FROM e JOIN f ON e.event_id = f.event_id) "
       "SELECT event_id, event, 'event=' || event || coalesce(' ' || string_agg(x, ' ' ORDER BY i), '') AS line FROM p WHERE event <> 'unknown' GROUP BY event_id, event")
def event_log(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    event = F.element_at(F.array(*map(F.lit, EVENT_KINDS)), (F.col("event_id") % len(EVENT_KINDS) + 1).cast("int"))
    values = [F.expr(v.replace("VARCHAR", "STRING")).alias(k) for k, v in EVENT_VALUES.items()]
    return metrics.event_lines(e.select("event_id", event.alias("event"), *values)).select("event_id", "event", "line")


FROM_MS, TO_MS = 1704500000000, 1705500000000


@query(f"WITH {MESSAGES} SELECT topic, count(*) AS n, CAST(count(*) * 1000.0 / {TO_MS - FROM_MS} AS DOUBLE) AS per_second FROM messages WHERE ts_ms >= {FROM_MS} AND ts_ms < {TO_MS} GROUP BY topic")
def rate_window(s, d):
    return metrics.rate(fx.messages(s, d), "topic", "ts_ms", FROM_MS, TO_MS).withColumn("per_second", F.col("per_second").cast("double"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999, max(value) AS max FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    return metrics.percentiles(s.read.parquet(f"{d}/events.parquet"), "value", "event_type")


@query(f"WITH {ARRIVALS} SELECT origin, count(DISTINCT seq) AS uniq, count(*) - count(DISTINCT seq) AS duplicates, max(seq) AS highest, max(seq) + 1 - count(DISTINCT seq) AS missing, CAST(CAST((max(seq) + 1 - count(DISTINCT seq)) * 100 AS DOUBLE) / (max(seq) + 1) AS DOUBLE) AS loss_pct FROM arrivals GROUP BY origin")
def soak_accounting(s, d):
    return metrics.soak(fx.arrivals(s, d), "origin", "seq").withColumn("loss_pct", (F.col("missing") * 100).cast("double") / (F.col("highest") + 1))


@query(f"WITH {MESSAGES} SELECT conn_id, ts_ms AS since, nxt - ts_ms AS silence FROM (SELECT conn_id, ts_ms, lead(ts_ms) OVER (PARTITION BY conn_id ORDER BY ts_ms) AS nxt FROM messages) WHERE nxt - ts_ms >= 12000000")
def idle_timeout(s, d):
    return metrics.quiet(fx.messages(s, d), ["conn_id"], "ts_ms", 12000000)


@query(f"WITH {MESSAGES} SELECT origin, ts_ms, ts_ms - b AS silence FROM (SELECT origin, ts_ms, lag(ts_ms) OVER (PARTITION BY origin ORDER BY ts_ms) AS b FROM messages) WHERE ts_ms - b > 3 * 600000")
def heartbeat_gap(s, d):
    return metrics.late_beats(fx.messages(s, d), ["origin"], "ts_ms", 600000)


# --- scalar functions


@query("SELECT event_id, encode(props) AS bytes, props AS text FROM events")
def utf8_round_trip(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.encode("props", "UTF-8").alias("bytes"), F.decode(F.encode("props", "UTF-8"), "UTF-8").alias("text"))


RAW_STATES = "CASE event_id % 5 WHEN 0 THEN 'ALIVE' WHEN 1 THEN 'suspect' WHEN 2 THEN 'DEAD' WHEN 3 THEN ' drop_gap ' ELSE 'Block' END"


@query(f"WITH x AS (SELECT event_id, {RAW_STATES} AS raw FROM events) SELECT event_id, CASE WHEN raw IN ('ALIVE', 'SUSPECT', 'DEAD', 'LEFT') THEN raw ELSE 'ALIVE' END AS state, CASE WHEN upper(trim(raw)) IN ('BLOCK', 'DROP_GAP') THEN upper(trim(raw)) ELSE 'BLOCK' END AS policy FROM x")
def enum_parse(s, d):
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(RAW_STATES).alias("raw"))
    return x.select("event_id", c.member_state(F.col("raw")).alias("state"), c.policy(F.col("raw"), ("BLOCK", "DROP_GAP"), "BLOCK").alias("policy"))


@query("SELECT s_suppkey, CAST(greatest(2, ceil(3 * log2(s_suppkey + 1))) AS BIGINT) AS lim, greatest(s_suppkey, 50) + 1 AS bumped, CAST(least(1000 * pow(2, s_suppkey % 8), 30000) AS BIGINT) AS backoff, least(s_name, 'Supplier#000000050') AS opens FROM supplier")
def protocol_numbers(s, d):
    x = s.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    return x.select(k, c.gossip_limit(k).alias("lim"), c.bumped_incarnation(k, F.lit(50)).alias("bumped"), c.backoff_ms(k % 8).alias("backoff"), c.initiator(F.col("s_name"), F.lit("Supplier#000000050")).alias("opens"))


@query("WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.example:7000, b:7001 ,,c' WHEN 1 THEN '' WHEN 2 THEN 'host-' || CAST(user_id AS VARCHAR) || ':9' ELSE 'nohost' END AS t FROM events) SELECT event_id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda v: trim(v)), lambda v: v <> ''), '|') AS items, regexp_extract(t, '^(.*):[^:]*$', 1) AS host, TRY_CAST(nullif(regexp_extract(t, ':([0-9]+)$', 1), '') AS INTEGER) AS port FROM x")
def seed_lists(s, d):
    t = F.expr("CASE event_id % 4 WHEN 0 THEN 'a.example:7000, b:7001 ,,c' WHEN 1 THEN '' WHEN 2 THEN 'host-' || CAST(user_id AS STRING) || ':9' ELSE 'nohost' END")
    x = s.read.parquet(f"{d}/events.parquet").select("event_id", t.alias("t"))
    host, port = c.host_port(F.col("t"))
    return x.select("event_id", F.array_join(c.csv_items(F.col("t")), "|").alias("items"), host.alias("host"), port.alias("port"))


@query("WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id * 1000 AS VARCHAR) || ':xxx' WHEN 1 THEN ':bad' ELSE 'no:' END AS data FROM events) SELECT event_id, CASE WHEN instr(data, ':') > 1 THEN TRY_CAST(split_part(data, ':', 1) AS BIGINT) END AS nanos FROM x")
def payload_timestamp(s, d):
    data = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(event_id * 1000 AS STRING) || ':xxx' WHEN 1 THEN ':bad' ELSE 'no:' END")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", c.payload_nanos(data).alias("nanos"))


# --- the cluster plane and the whole snapshot


ARM_FIELDS = {kind: [x.split(":") for x in cluster.MESSAGES[kind].split()] for kind in cluster.ARMS}
PLAIN = sorted({(name, kind) for own in ARM_FIELDS.values() for name, kind in own if kind in "sib"})
PLAIN_VALUES = {"s": "'{0}' || CAST(event_id % 7 AS VARCHAR)", "i": "event_id * {1}", "b": "encode(props)"}


def _plain(name: str, kind: str) -> str:
    return PLAIN_VALUES[kind].format(name, 1 + len(name))


@query(f"WITH k AS (SELECT event_id, props, {list(cluster.ARMS)}[1 + event_id % {len(cluster.ARMS)}] AS kind FROM events) SELECT event_id, kind, " + ", ".join(f"CASE WHEN kind IN ({', '.join(repr(a) for a, own in ARM_FIELDS.items() if [n, t] in own)}) THEN {_plain(n, t)} END AS {n}" for n, t in PLAIN) + " FROM k")
def cluster_round_trip(s, d):
    """Messages of all arms, encoded to envelopes and decoded again: each has the fields of its arm only."""
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, cluster.ARMS)), (F.col("event_id") % len(cluster.ARMS) + 1).cast("int"))
    values = [F.expr(_plain(n, t).replace("VARCHAR", "STRING").replace("encode(props)", "encode(props, 'UTF-8')")).alias(n) for n, t in PLAIN]
    decoded = formats.decode_cluster(formats.encode_cluster(e.select("event_id", kind.alias("kind"), *values)).select("event_id", "frame"))
    return decoded.select("event_id", "kind", *[n for n, _ in PLAIN])


#: Of each metric that the fixtures have: the query that it sums up, and how, in SQL that both engines share.
SNAPSHOT = {
    "messagesPublished": ("reject_invalid", "count(*)"),
    "messagesDelivered": ("fanout", "count(*)"),
    "totalConnectionsAccepted": ("admission", "count_if(admitted)"),
    "connectionsRejected": ("admission", "count_if(NOT admitted)"),
    "subscriptionCount": ("subscriber_count", "sum(subscribers)"),
    "maxOutboundQueueDepth": ("max_depth", "max(deepest)"),
    "cluster_messagesForwarded": ("route_interest", "count(*)"),
    "cluster_messagesReceived": ("cluster_counters", "max(cluster_messagesReceived)"),
    "cluster_messagesDeduped": ("cluster_counters", "max(cluster_messagesDeduped)"),
    "cluster_activePeerLinks": ("link_seq", "count(DISTINCT concat(origin, '>', node))"),
    "cluster_replayBufferDepth": ("replay_depth", "sum(depth)"),
    "cluster_gapEvents": ("gaps", "count(*)"),
    "cluster_acksSent": ("ack_advanced", "count(*)"),
    "cluster_acksReceived": ("demux_cluster", "count_if(arm = 'ack')"),
    "cluster_interestUpdatesSent": ("interest_edges", "count(*)"),
    "cluster_interestUpdatesReceived": ("interest_accepted", "count(*)"),
    "cluster_interestRoutedSkipped": ("routed_skipped", "count(*)"),
    "cluster_routingTableTopicCount": ("routing_snapshot", "count(*)"),
    "cluster_membersAlive": ("member_counts", "sum(CASE WHEN state = 'alive' THEN members ELSE 0 END)"),
    "cluster_membersSuspect": ("member_counts", "sum(CASE WHEN state = 'suspect' THEN members ELSE 0 END)"),
    "cluster_membersDead": ("member_counts", "sum(CASE WHEN state = 'dead' THEN members ELSE 0 END)"),
    "cluster_joinEvents": ("demux_cluster", "count_if(arm = 'join')"),
    "cluster_leaveEvents": ("demux_cluster", "count_if(arm = 'leave')"),
    "cluster_suspectEvents": ("event_log", "count_if(event = 'suspect')"),
    "cluster_deadEvents": ("event_log", "count_if(event = 'dead')"),
    "cluster_handshakeAuthFailures": ("event_log", "count_if(event = 'handshake-auth-failure')"),
    "cluster_indirectProbesSent": ("probe_timeouts", "count(*)"),
    "cluster_gossipMessagesReceived": ("demux_cluster", "count_if(arm IN ('ping', 'ping_ack', 'ping_req', 'join_ack'))"),
}

#: Those that need fewer rows than their query has: deliveries follow from counts per topic, links from what is routed.
SUMMED = {
    "messagesDelivered": ("fanout_count", "max(delivered)"),
    "cluster_activePeerLinks": ("route_interest", SNAPSHOT["cluster_activePeerLinks"][1]),
}


@query("WITH " + ", ".join(f"s{i} AS (SELECT '{n}' AS name, CAST({how} AS BIGINT) AS value FROM ({ORACLE_SQL[q]}))" for i, (n, (q, how)) in enumerate(SNAPSHOT.items()))
       + ", found AS (" + " UNION ALL ".join(f"FROM s{i}" for i in range(len(SNAPSHOT))) + f"), names(name) AS (VALUES {', '.join(f'({n!r})' for n in metrics.names())}) SELECT name, coalesce(value, 0) AS value FROM names LEFT JOIN found USING (name)")
def metrics_snapshot(s, d):
    """All 36 metrics at once; those of which the fixtures have nothing are 0. Each query is summed up once."""
    by_query: dict[str, dict[str, str]] = {}
    for n, (q, how) in SNAPSHOT.items():
        q, how = SUMMED.get(n, (q, how))
        by_query.setdefault(q, {})[n] = how
    rows = {"fanout_count": lambda s, d: delivery.fan_out_count(valid(s, d), fx.subscriptions(s, d))}
    parts = [metrics.flat({**QUERIES, **rows}[q](s, d).selectExpr(*[f"cast({how} AS bigint) AS `{n}`" for n, how in hows.items()]), tuple(hows)) for q, hows in by_query.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return metrics.snapshot(found)
