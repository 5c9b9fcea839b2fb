"""Envelopes of the cluster plane: 17 kinds, decoded to plain values and encoded again."""

from __future__ import annotations

from tidewire.sources.framing import FrameError, fields, varint

STATES = ("ALIVE", "SUSPECT", "DEAD", "LEFT")

#: Fixed schema: fields in the order of their numbers from 1. s string, b bytes, i integer, e state, S strings, other: a list of that message.
MESSAGES = {
    "ack_entry": "origin_node_id:s origin_epoch:i acked_seq:i",
    "resume_entry": "origin_node_id:s origin_epoch:i last_contiguous_seq:i",
    "gossip": "node_id:s state:e incarnation:i host:s cluster_port:i",
    "publish": "topic:s source:s origin_node_id:s origin_epoch:i seq:i link_seq:i data:b",
    "ack": "acker_node_id:s acks:ack_entry",
    "resume": "node_id:s resume:resume_entry",
    "gap": "sender_node_id:s origin_node_id:s origin_epoch:i first_available_seq:i",
    "interest": "node_id:s interest_version:i op:s topic:s",
    "interest_sync": "node_id:s interest_version:i topics:S",
    "auth_hello": "node_id:s host:s cluster_port:i incarnation:i nonce:b protocol:s",
    "auth_challenge": "node_id:s host:s cluster_port:i incarnation:i nonce:b proof:b",
    "auth_response": "node_id:s proof:b",
    "heartbeat": "node_id:s",
    "ping": "seq_no:i piggyback:gossip",
    "ping_ack": "seq_no:i piggyback:gossip",
    "ping_req": "target_node_id:s seq_no:i piggyback:gossip",
    "ping_req_ack": "target_node_id:s seq_no:i piggyback:gossip",
    "join": "node_id:s host:s cluster_port:i incarnation:i",
    "join_ack": "members:gossip",
    "leave": "node_id:s incarnation:i",
}
#: Fixed arms of the envelope, in the order of their numbers from 1.
ARMS = tuple(MESSAGES)[3:]
_EMPTY = {"s": "", "b": b"", "i": 0, "e": "ALIVE"}


def _fields(name: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in MESSAGES[name].split()]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def decode(name: str, raw: bytes) -> dict:
    known = _fields(name)
    out = {field: _EMPTY.get(kind, []) if kind in _EMPTY else [] for field, kind in known}
    for number, value in fields(raw):
        if not 1 <= number <= len(known):
            continue
        field, kind = known[number - 1]
        if isinstance(value, int) != (kind in "ie"):
            raise FrameError(f"{name}.{field}")
        try:
            if kind == "i":
                out[field] = _signed(value)
            elif kind == "e":
                out[field] = STATES[value] if value < len(STATES) else "ALIVE"
            elif kind == "b":
                out[field] = value
            elif kind == "s":
                out[field] = value.decode("utf-8")
            else:
                out[field].append(value.decode("utf-8") if kind == "S" else decode(kind, value))
        except UnicodeDecodeError as e:
            raise FrameError(f"{name}.{field}") from e
    return out


def encode(name: str, message: dict) -> bytes:
    out = b""
    for number, (field, kind) in enumerate(_fields(name), 1):
        value = message.get(field)
        if kind in "ie":
            n = STATES.index(value or "ALIVE") if kind == "e" else int(value or 0)
            if n:
                out += varint(number << 3) + varint(n % (1 << 64))
            continue
        if kind in "sb":
            items = [value] if value else []
        else:
            items = value or []
        for x in items:
            raw = x.encode("utf-8") if isinstance(x, str) else encode(kind, x) if isinstance(x, dict) else bytes(x)
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def decode_envelope(raw: bytes, most: int | None = None) -> dict:
    """{"kind": arm or "", and its fields}; the last arm counts, as in any oneof."""
    if most is not None and len(raw) > most:
        raise FrameError("too large")
    kind, body = "", b""
    for number, value in fields(raw):
        if 1 <= number <= len(ARMS) and isinstance(value, bytes):
            kind, body = ARMS[number - 1], value
    return {"kind": kind, **(decode(kind, body) if kind else {})}


def encode_envelope(message: dict, most: int | None = None) -> bytes:
    body = encode(message["kind"], message)
    out = varint(ARMS.index(message["kind"]) + 1 << 3 | 2) + varint(len(body)) + body
    if most is not None and len(out) > most:
        raise FrameError("too large")
    return out
