"""Ordered folds that no window expresses: the same step functions serve batch (`mapInArrow`) and streams.

A fold is a function from a state (a plain dict that pickles) and one event to the rows that it gives. Groups are
keyed, and events are folded in the order of `arrival`.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[dict, dict], Iterable[tuple]]


def tracker(window: int = 4096) -> Step:
    """Duplicates by a window of sequences after the frontier; gives (event_id, accepted, overrun, frontier).

    A sequence up to the frontier is a duplicate. One that is `window` or more places after frontier + 1 moves the
    frontier to itself and clears the window. An event of kind RESET sets the frontier to its seq, be it backward.
    """

    def step(state: dict, event: dict) -> Iterable[tuple]:
        frontier, held = state.get("frontier", 0), state.setdefault("held", set())
        seq, overrun = event["seq"], False
        if event.get("kind") == "RESET":
            state["frontier"] = seq
            held.clear()
            return []
        if seq <= frontier or seq in held:
            accepted = False
        elif seq - frontier - 1 >= window:
            accepted = overrun = True
            frontier = seq
            held.clear()
        else:
            accepted = True
            held.add(seq)
            while frontier + 1 in held:
                frontier += 1
                held.discard(frontier)
        state["frontier"] = frontier
        return [(event["event_id"], accepted, overrun, frontier)]

    return step


def strict_order(window: int = 4096) -> Step:
    """Strict delivery: accepted messages wait until the frontier reaches them; gives (event_id, seq, position)."""
    accept = tracker(window)

    def step(state: dict, event: dict) -> Iterable[tuple]:
        inner, waiting = state.setdefault("tracker", {}), state.setdefault("waiting", [])
        out = []
        if event.get("kind") == "RESET":
            accept(inner, event)
            state["waiting"] = waiting = [x for x in waiting if x[0] > event["seq"]]
            heapq.heapify(waiting)
        else:
            ((_, accepted, overrun, _),) = accept(inner, event)
            if overrun:
                state["position"] = state.get("position", 0) + 1
                out.append((event["event_id"], event["seq"], state["position"]))
            elif accepted:
                heapq.heappush(waiting, (event["seq"], event["event_id"]))
        while waiting and waiting[0][0] <= inner.get("frontier", 0):
            seq, event_id = heapq.heappop(waiting)
            state["position"] = state.get("position", 0) + 1
            out.append((event_id, seq, state["position"]))
        return out

    return step


def replay_buffer(capacity: int, policy: str = "DROP_GAP", offer_ms: int = 0) -> Step:
    """A bounded buffer of appends and cumulative acks; gives (arrival, seq, outcome, depth) for each append decided.

    DROP_GAP drops the newest when full. BLOCK lets an append wait, in event time, until an ack frees a place or
    offer_ms are over; later appends start after it, as one writer makes them all.
    """

    def step(state: dict, event: dict) -> Iterable[tuple]:
        ring, acked, waiting = state.setdefault("ring", []), state.get("acked", 0), state.setdefault("waiting", [])
        out = []

        def admit(now: int) -> None:
            while waiting:
                arrival, seq, since = waiting[0]
                if len(ring) < capacity and now <= since + offer_ms:
                    ring.append(seq)
                    out.append((arrival, seq, "accepted", len(ring)))
                    ended = now
                elif now >= since + offer_ms:
                    out.append((arrival, seq, "gap", len(ring)))
                    ended = since + offer_ms
                else:
                    return
                waiting.pop(0)
                if waiting:  # one writer: the next append starts when this one has ended
                    waiting[0] = (*waiting[0][:2], max(waiting[0][2], ended))

        now = event["at_ms"]
        if policy == "BLOCK":
            while waiting and waiting[0][2] + offer_ms < now:
                admit(waiting[0][2] + offer_ms)
        if event["kind"] == "ACK":
            if event["seq"] > acked:
                state["acked"] = event["seq"]
                ring[:] = [s for s in ring if s > event["seq"]]
            admit(now)
        elif event["kind"] == "APPEND":
            state["highest"] = max(state.get("highest", 0), event["seq"])
            if len(ring) < capacity and not waiting:
                ring.append(event["seq"])
                out.append((event["arrival"], event["seq"], "accepted", len(ring)))
            elif policy == "DROP_GAP":
                out.append((event["arrival"], event["seq"], "gap", len(ring)))
            else:
                waiting.append((event["arrival"], event["seq"], now))
        elif event["kind"] == "END":
            while waiting:
                admit(waiting[0][2] + offer_ms)
        return out

    return step


def ingest_queue(capacity: int) -> Step:
    """A bounded queue of PUT and TAKE events; gives (arrival, seq, outcome, depth) for each PUT."""

    def step(state: dict, event: dict) -> Iterable[tuple]:
        depth = state.get("depth", 0)
        if event["kind"] == "TAKE":
            state["depth"] = max(0, depth - 1)
            return []
        fits = depth < capacity
        state["depth"] = depth + fits
        return [(event["arrival"], event["seq"], "queued" if fits else "dropped", state["depth"])]

    return step


def membership(local: str | None = None) -> Step:
    """Merges member facts; gives (arrival, node, before, after, incarnation, transition, refuted_with).

    ALIVE wins by a higher incarnation, or by an equal one over SUSPECT. SUSPECT needs an incarnation that isn't lower
    and a member that isn't DEAD. DEAD needs one that isn't lower. LEFT always applies. Incarnations never fall. Facts
    that call the local node SUSPECT or DEAD are answered with a higher incarnation. Unknown states count as ALIVE.
    """
    states = ("ALIVE", "SUSPECT", "DEAD", "LEFT")
    names = {"SUSPECT": "suspect", "DEAD": "dead", "LEFT": "leave"}

    def step(state: dict, event: dict) -> Iterable[tuple]:
        node, incarnation = event["node"], event["incarnation"]
        if node == local:
            if event["state"] not in ("SUSPECT", "DEAD") or incarnation < state.get("incarnation", 0):
                return []
            state["incarnation"] = max(state.get("incarnation", 0), incarnation) + 1
            return [(event["arrival"], node, "ALIVE", "ALIVE", state["incarnation"], "refute", state["incarnation"])]
        new = event["state"] if event["state"] in states else "ALIVE"
        old = state.get("state")
        if old is None:
            state.update(state=new, incarnation=incarnation, changed_ms=event["at_ms"])
            return [(event["arrival"], node, None, new, incarnation, "join" if new == "ALIVE" else names[new], None)]
        current = state["incarnation"]
        accepted = {
            "ALIVE": incarnation > current or (incarnation == current and old == "SUSPECT"),
            "SUSPECT": incarnation >= current and old != "DEAD",
            "DEAD": incarnation >= current,
            "LEFT": True,
        }[new]
        if not accepted or (old == new and incarnation <= current):
            return []
        state["incarnation"] = max(current, incarnation)
        if old == new:
            return []
        state.update(state=new, changed_ms=event["at_ms"])
        return [(event["arrival"], node, old, new, state["incarnation"], names.get(new, "alive"), None)]

    return step


def bounded_delivery(capacity: int, offer_ms: int, policy: str) -> Step:
    """A client's queue whose writers wait for a place; gives (arrival, outcome): enqueued, dropped or disconnected.

    A PUT that finds the queue full waits, behind those that wait already, until a TAKE frees a place; one that has
    waited longer than offer_ms is dropped (DROP_MESSAGE) or ends the connection (DISCONNECT_SLOW_CONSUMER), after which
    nothing is given. END lets all that still wait run out.
    """

    def step(state: dict, event: dict) -> Iterable[tuple]:
        waiting, now, out = state.setdefault("waiting", []), event["at_ms"], []
        if state.get("closed"):
            return []
        while waiting and (event["kind"] == "END" or waiting[0][1] + offer_ms < now):
            arrival, _ = waiting.pop(0)
            if policy != "DROP_MESSAGE":
                state["closed"] = True
                return [*out, (arrival, "disconnected")]
            out.append((arrival, "dropped"))
        depth = state.get("depth", 0)
        if event["kind"] == "TAKE" and waiting:
            out.append((waiting.pop(0)[0], "enqueued"))  # its place is taken at once
        elif event["kind"] == "TAKE":
            state["depth"] = max(0, depth - 1)
        elif event["kind"] == "PUT" and depth < capacity and not waiting:
            state["depth"] = depth + 1
            out.append((event["arrival"], "enqueued"))
        elif event["kind"] == "PUT":
            waiting.append((event["arrival"], now))
        return out

    return step


def grace_delivery(capacity: int, offer_ms: int, policy: str) -> Step:
    """A client's queue whose writers never wait; gives (arrival, outcome) as bounded_delivery does.

    The capacity is a soft one: the first PUT at or over it starts a timer, and until offer_ms are over all are enqueued.
    From then on they are dropped, or the first one ends the connection. A PUT that finds the queue under its capacity
    stops the timer.
    """

    def step(state: dict, event: dict) -> Iterable[tuple]:
        depth = state.get("depth", 0)
        if state.get("closed") or event["kind"] == "END":
            return []
        if event["kind"] == "TAKE":
            state["depth"] = max(0, depth - 1)
            return []
        if depth < capacity:
            state["since"] = None
        elif state.get("since") is None:
            state["since"] = event["at_ms"]
        if depth >= capacity and event["at_ms"] - state["since"] >= offer_ms:
            state["closed"] = policy != "DROP_MESSAGE"
            return [(event["arrival"], "disconnected" if state["closed"] else "dropped")]
        state["depth"] = depth + 1
        return [(event["arrival"], "enqueued")]

    return step


def admission(limit: int) -> Step:
    """Connections of a listener; gives (conn_id, at_ms, active, admitted) for each OPEN.

    An OPEN is admitted while fewer than `limit` are active (0: always); active counts it in. One that is rejected is
    never active, so its CLOSE, or any of a connection that isn't active, changes nothing.
    """

    def step(state: dict, event: dict) -> Iterable[tuple]:
        held, conn = state.setdefault("held", {}), event["conn_id"]
        if event["kind"] == "CLOSE" and held.get(conn):
            held[conn] -= 1
            state["active"] -= 1
        if event["kind"] != "OPEN":
            return []
        active = state.get("active", 0) + 1
        admitted = limit == 0 or active <= limit
        if admitted:
            held[conn], state["active"] = held.get(conn, 0) + 1, active
        return [(conn, event["at_ms"], active, admitted)]

    return step


def fold(events: Iterable[dict], step: Step) -> list[tuple]:
    """All rows of one key's events, which are in order."""
    state: dict = {}
    return [row for e in events for row in step(state, e)]


def apply_fold(df: DataFrame, keys: list[str], step: Step, schema: str, *, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Fold each key's rows. schema: the columns of the rows that the step gives.

    A key's rows are folded by one task, as the order of one key is serial by nature; keys spread over the tasks. Rows
    stream through in batches, sorted by Spark (which spills): a task holds one batch and the state of one key.
    """
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{types}, {schema}"
    fields = to_arrow_schema(T.StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, {}
        for batch in batches:
            out = []
            for event in batch.to_pylist():
                key = tuple(event[k] for k in keys)
                if key != current:
                    current, state = key, {}
                out += [(*key, *row) for row in step(state, event)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)
