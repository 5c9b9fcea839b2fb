"""Folds against expected outcomes, an independent tracker, and their streaming form."""

import random

import pytest

from tidewire.operators import folds
from tidewire.plans import fixtures as fx
from tidewire.plans import fold_queries as q


@pytest.fixture(autouse=True)
def small(monkeypatch, request):
    """Parameters that the small fixtures reach the end of."""
    slow = "slow" in request.node.name
    for name, value in (("WINDOW", 64), ("RING", 8), ("QUEUE", 8 if slow else 16), ("OFFER_MS", 20_000_000 if slow else 50)):
        monkeypatch.setattr(q, name, value)


def msgs(*seqs):
    return [{"event_id": i, "seq": s, "kind": "MSG", "arrival": i} for i, s in enumerate(seqs)]


def accepted(window, *seqs):
    return [r[1] for r in folds.fold(msgs(*seqs), folds.tracker(window))]


def slow_tracker(window, events):
    """The same rules over a plain set of all accepted sequences after the last jump."""
    frontier, held, out = 0, set(), []
    for e in events:
        s = e["seq"]
        if s <= frontier or s in held:
            out.append((False, frontier))
            continue
        if s > frontier + window:
            frontier, held = s, set()
        else:
            held.add(s)
            while frontier + 1 in held:
                frontier += 1
        out.append((True, frontier))
    return out


def test_window_edges():
    assert accepted(4096, 4096) == [True]
    assert folds.fold(msgs(4096), folds.tracker(4096))[0][2:] == (False, 0)
    assert folds.fold(msgs(4097), folds.tracker(4096))[0][2:] == (True, 4097)
    assert accepted(4, 2, 2, 1, 1, 7, 3) == [True, False, True, False, True, False]


@pytest.mark.parametrize("seed", range(20))
def test_tracker_against_plain_set(seed):
    rng = random.Random(seed)
    events = msgs(*[max(1, i // 2 + rng.randint(-6, 12)) for i in range(300)])
    found = [(r[1], r[3]) for r in folds.fold(events, folds.tracker(8))]
    assert found == slow_tracker(8, events)


def test_reset_moves_backward():
    events = msgs(1, 2, 3) + [{"event_id": 9, "seq": 1, "kind": "RESET"}] + msgs(2, 3)
    assert [r[1] for r in folds.fold(events, folds.tracker(8))] == [True] * 5


def test_strict_order_waits_and_flushes():
    out = folds.fold(msgs(2, 1, 4, 3, 3), folds.strict_order(8))
    assert [r[1] for r in out] == [1, 2, 3, 4]
    assert [r[2] for r in out] == [1, 2, 3, 4]


def append(seq, at):
    return {"arrival": seq, "kind": "APPEND", "seq": seq, "at_ms": at}


def test_drop_gap_drops_the_newest():
    out = folds.fold([append(s, s) for s in (1, 2, 3, 4)], folds.replay_buffer(3))
    assert [r[2] for r in out] == ["accepted"] * 3 + ["gap"]


def test_block_then_ack():
    events = [append(1, 0), append(2, 1), append(3, 2), {"arrival": 9, "kind": "ACK", "seq": 1, "at_ms": 20}]
    assert [r[1:3] for r in folds.fold(events, folds.replay_buffer(2, "BLOCK", 50))] == [(1, "accepted"), (2, "accepted"), (3, "accepted")]


def test_block_times_out():
    events = [append(1, 0), append(2, 1), append(3, 2), {"arrival": 9, "kind": "END", "seq": 0, "at_ms": 999}]
    assert folds.fold(events, folds.replay_buffer(2, "BLOCK", 50))[-1][1:3] == (3, "gap")


def test_stale_ack_is_ignored():
    step, state = folds.replay_buffer(10), {}
    for e in [append(s, s) for s in range(1, 6)] + [{"kind": "ACK", "seq": 3, "at_ms": 9}, {"kind": "ACK", "seq": 1, "at_ms": 10}]:
        list(step(state, e))
    assert state["ring"] == [4, 5]


def test_members():
    log = [dict(zip(fx.MEMBER_COLUMNS.split(", "), r, strict=True)) for r in fx.MEMBER_LOG]
    by = {}
    for e in log:
        by.setdefault(e["node"], []).append(e)
    out = {n: [(r[2], r[3]) for r in folds.fold(es, folds.membership())] for n, es in by.items()}
    assert out["n1"] == [(None, "ALIVE"), ("ALIVE", "SUSPECT"), ("SUSPECT", "ALIVE"), ("ALIVE", "DEAD")]
    assert out["n2"] == [(None, "ALIVE"), ("ALIVE", "DEAD"), ("DEAD", "ALIVE")]
    assert out["n3"][-2:] == [("ALIVE", "LEFT"), ("LEFT", "SUSPECT")]
    assert out["n4"] == [(None, "ALIVE"), ("ALIVE", "LEFT")]
    assert out["n5"] == [(None, "ALIVE")]
    assert [r[-1] for r in folds.fold(by["n1"], folds.membership("n1"))] == [101, 102]


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_fold_queries_run(spark, sf_dir, name):
    assert q.QUERIES[name](spark, sf_dir).count() > 0


def test_batch_fold_equals_plain_fold(spark, sf_dir):
    found = sorted((r.origin, r.event_id, r.accepted, r.frontier) for r in q.window_overrun(spark, sf_dir).collect())
    groups = {}
    for r in fx.arrivals(spark, sf_dir, late=True).select("origin", "event_id", "seq", "arrival").collect():
        groups.setdefault(r.origin, []).append(r.asDict())
    expected = []
    for origin, events in groups.items():
        events.sort(key=lambda e: e["arrival"])
        expected += [(origin, e["event_id"], a, f) for e, (a, f) in zip(events, slow_tracker(q.WINDOW, events), strict=True)]
    assert found == sorted(expected)
    assert any(r.overrun for r in q.window_overrun(spark, sf_dir).where("overrun").collect())


def queue(*events):
    return [{"arrival": i, "kind": "PUT" if k == "p" else "TAKE" if k == "t" else "END", "at_ms": at} for i, (k, at) in enumerate(events)]


def outcomes(step, events):
    return {r[0]: r[1] for r in folds.fold(events, step)}


def test_writers_wait_for_a_place():
    events = queue(("p", 0), ("p", 5), ("p", 9), ("t", 14), ("p", 16), ("e", 99))
    assert outcomes(folds.bounded_delivery(1, 10, "DROP_MESSAGE"), events) == {0: "enqueued", 1: "enqueued", 2: "dropped", 4: "dropped"}
    assert outcomes(folds.bounded_delivery(1, 10, "DISCONNECT_SLOW_CONSUMER"), events) == {0: "enqueued", 1: "enqueued", 2: "disconnected"}


def test_grace_enqueues_until_the_timer_ends():
    events = queue(("p", 0), ("p", 5), ("p", 14), ("p", 15), ("p", 16), ("t", 17), ("t", 17), ("t", 17), ("p", 18), ("p", 19), ("p", 28))
    assert [r[1] for r in folds.fold(events, folds.grace_delivery(1, 10, "DROP_MESSAGE"))] == ["enqueued", "enqueued", "enqueued", "dropped", "dropped", "enqueued", "enqueued", "enqueued"]
    assert [r[1] for r in folds.fold(events, folds.grace_delivery(1, 10, "DISCONNECT_SLOW_CONSUMER"))] == ["enqueued", "enqueued", "enqueued", "disconnected"]


def waited(capacity, offer, drop, events):
    """The blocking queue by a clock that goes on by one, each writer with a deadline of its own."""
    depth, writers, out, closed = 0, {}, {}, False
    last = max(e["at_ms"] for e in events) + offer + 2
    for now in range(last):
        for i in [i for i, due in writers.items() if due < now]:
            if not closed:
                out[i], closed = "dropped" if drop else "disconnected", not drop
            del writers[i]
        for e in events:
            if e["at_ms"] != now or closed or e["kind"] == "END":
                continue
            if e["kind"] == "TAKE":
                depth = max(0, depth - 1)
            else:
                writers[e["arrival"]] = now + offer
            while writers and depth < capacity:
                out[i := min(writers)] = "enqueued"
                depth += 1
                del writers[i]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_waiting_against_a_clock(seed):
    rng = random.Random(seed)
    times = sorted(rng.randint(0, 60) for _ in range(40))
    events = queue(*[(rng.choice("ppt"), at) for at in times], ("e", 10**6))
    events[-1]["at_ms"] = times[-1] + 100
    for drop in (True, False):
        policy = "DROP_MESSAGE" if drop else "DISCONNECT_SLOW_CONSUMER"
        assert outcomes(folds.bounded_delivery(3, 7, policy), events) == waited(3, 7, drop, events)


def test_rejected_opens_hold_no_place():
    log = [("OPEN", "a"), ("OPEN", "b"), ("CLOSE", "b"), ("CLOSE", "a"), ("OPEN", "c"), ("OPEN", "d"), ("CLOSE", "d"), ("OPEN", "e")]
    events = [{"kind": k, "conn_id": c, "at_ms": i} for i, (k, c) in enumerate(log)]
    assert [(r[0], r[3]) for r in folds.fold(events, folds.admission(1))] == [("a", True), ("b", False), ("c", True), ("d", False), ("e", False)]
    never_closed = [events[0], events[1], events[3], events[4]]
    assert [r[3] for r in folds.fold(never_closed, folds.admission(1))] == [True, False, True]
    assert all(r[3] for r in folds.fold(events, folds.admission(0)))


def by_key(rows, key, order):
    groups = {}
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
        groups.setdefault(r[key], []).append(r.asDict())
    return groups


def plain_resets(events, window):
    frontier, held, out = 0, set(), []
    for e in events:
        if e["kind"] == "RESET":
            frontier, held = e["seq"], set()
            continue
        fresh = e["seq"] > frontier and e["seq"] not in held
        over = fresh and e["seq"] > frontier + window
        if over:
            frontier, held = e["seq"], set()
        elif fresh:
            held |= {e["seq"]}
            while frontier + 1 in held:
                held -= {frontier + 1}
                frontier += 1
        out.append((e["event_id"], fresh, over, frontier))
    return out


def plain_order(events, window):
    tracked = iter(plain_resets(events, window))
    waiting, out = {}, []
    for e in events:
        event_id, fresh, over, frontier = next(tracked)
        if over:
            out.append((event_id, e["seq"]))
        elif fresh:
            waiting[e["seq"]] = event_id
        for seq in sorted(x for x in waiting if x <= frontier):
            out.append((waiting.pop(seq), seq))
    return [(*x, i + 1) for i, x in enumerate(out)]


def plain_drops(events, capacity):
    held, out = [], []
    for e in events:
        if e["kind"] == "ACK":
            held = [x for x in held if x > e["seq"]]
        elif e["kind"] == "APPEND":
            fits = len(held) < capacity
            held += [e["seq"]] * fits
            out.append((e["arrival"], e["seq"], "accepted" if fits else "gap", len(held)))
    return out


def plain_blocks(events, capacity, offer):
    """Appends one after the other: each starts when it comes or the one before is decided, and ends by an ack or its offer."""
    held, acks, out, free_at = [], [e for e in events if e["kind"] == "ACK"], [], -1
    at = 0
    for e in (e for e in events if e["kind"] == "APPEND"):
        start = max(e["at_ms"], free_at)
        while True:
            while at < len(acks) and (acks[at]["at_ms"], acks[at]["arrival"]) < (start, e["arrival"] if start == e["at_ms"] else 10**9):
                held = [x for x in held if x > acks[at]["seq"]]
                at += 1
            if len(held) < capacity or at == len(acks) or acks[at]["at_ms"] > max(e["at_ms"], free_at) + offer:
                break
            start = acks[at]["at_ms"]
            held = [x for x in held if x > acks[at]["seq"]]
            at += 1
        fits = len(held) < capacity
        free_at = start if fits else max(e["at_ms"], free_at) + offer
        held += [e["seq"]] * fits
        out.append((e["arrival"], e["seq"], "accepted" if fits else "gap", len(held)))
    return out


def plain_puts(events, capacity):
    depth, out = 0, []
    for e in events:
        if e["kind"] == "TAKE":
            depth -= depth > 0
        else:
            out.append((e["arrival"], e["seq"], "dropped" if depth >= capacity else "queued", min(capacity, depth + 1)))
            depth = min(capacity, depth + 1)
    return out


def late(spark, sf_dir):
    return [*q._late(spark, sf_dir).select("origin", "event_id", "seq", "arrival", "kind").collect()]


@pytest.mark.parametrize("name", ["gap_reset", "strict_order_fold", "replay_drop_gap", "replay_block", "ingest_overflow", "slow_consumers_drop", "slow_consumers_grace"])
def test_whole_queries_against_plain_loops(spark, sf_dir, name):
    key = "conn_id" if name.startswith("slow") else "origin"
    if name == "gap_reset":
        rows = late(spark, sf_dir)
        resets = [r for r in rows if r.event_id % 500 == 3]
        rows += [type(r)(origin=r.origin, event_id=r.event_id, seq=r.seq + (-10 if r.event_id % 1000 == 3 else 20), arrival=r.arrival + 1, kind="RESET") for r in resets]
        expected = {k: plain_resets(v, q.WINDOW) for k, v in by_key(rows, key, ("arrival", "kind")).items()}
    elif name == "strict_order_fold":
        expected = {k: plain_order(v, q.WINDOW) for k, v in by_key(late(spark, sf_dir), key, ("arrival",)).items()}
    elif name.startswith("replay"):
        groups = by_key(q._replay_events(spark, sf_dir).collect(), key, ("at_ms", "arrival"))
        expected = {k: plain_drops(v, 8) if name == "replay_drop_gap" else plain_blocks(v, 8, 50) for k, v in groups.items()}
    elif name == "ingest_overflow":
        m = fx.sequenced(spark, sf_dir).selectExpr("origin", "event_id AS arrival", "CASE WHEN event_id % 3 = 0 THEN 'TAKE' ELSE 'PUT' END AS kind", "seq").collect()
        expected = {k: plain_puts(v, 16) for k, v in by_key(m, key, ("arrival",)).items()}
    else:
        expected = {}
        for k, v in by_key(q._queue_events(spark, sf_dir).collect(), key, ("arrival",)).items():
            if name == "slow_consumers_drop":
                waits, depth, out = [], 0, []
                for e in v:
                    due = [w for w in waits if e["kind"] == "END" or w[1] < e["at_ms"]]
                    out += [(i, "dropped") for i, _ in due]
                    waits = [w for w in waits if w not in due]
                    if e["kind"] == "TAKE":
                        depth -= depth > 0
                    elif e["kind"] == "PUT":
                        waits.append((e["arrival"], e["at_ms"] + q.OFFER_MS))
                    if waits and depth < 8:
                        out.append((waits.pop(0)[0], "enqueued"))
                        depth += 1
            else:
                depth, began, out = 0, None, []
                for e in (e for e in v if e["kind"] != "END"):
                    if e["kind"] == "TAKE":
                        depth -= depth > 0
                        continue
                    began = None if depth < 8 else e["at_ms"] if began is None else began
                    keep = began is None or e["at_ms"] < began + q.OFFER_MS
                    depth += keep
                    out.append((e["arrival"], "enqueued" if keep else "dropped"))
            expected[k] = out
    found = sorted(tuple(r) for r in q.QUERIES[name](spark, sf_dir).collect())
    assert found == sorted((k, *r) for k, rows in expected.items() for r in rows)
    kinds = {r[-1] if name.startswith("slow") else r[3] for r in found}
    assert len(kinds) > 1
