"""Length-prefixed frames and their envelopes: decoding, encoding, and a partial-read decoder.

A frame is a four-byte big-endian length and that many bytes. The envelope is a protocol-buffer message with one of
six client arms; the wire rules that it needs (varints, length-delimited fields, skipping of unknown ones) are here, so
no generated classes are needed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

#: Fixed field numbers of the client envelope's arms and of their fields.
ARMS = {1: "auth_request", 2: "auth_response", 3: "subscribe", 4: "subscribe_ack", 5: "publish_inbound", 6: "publish_outbound"}
FIELDS = {
    "auth_request": {1: "secret"},
    "auth_response": {1: "token"},
    "subscribe": {1: "topic", 2: "token"},
    "subscribe_ack": {1: "topic"},
    "publish_inbound": {1: "topic", 2: "source", 3: "token", 4: "data"},
    "publish_outbound": {1: "topic", 2: "source", 3: "data"},
}


class FrameError(ValueError):
    pass


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise FrameError("varint")
        value |= (raw[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 0x80:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field."""
    at = 0
    while at < len(raw):
        tag, at = read_varint(raw, at)
        number, kind = tag >> 3, tag & 7
        if not number:
            raise FrameError("field number 0")
        if kind == 0:
            value, at = read_varint(raw, at)
        elif kind in (1, 2, 5):
            n, at = read_varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + n], at + n
            if at > len(raw):
                raise FrameError("cut field")
        else:
            raise FrameError(f"wire type {kind}")
        yield number, value


def decode_envelope(raw: bytes, most: int | None = None) -> dict:
    """{"kind": arm or "", and the arm's fields}: strings, but data as bytes; unset ones are empty."""
    if most is not None and len(raw) > most:
        raise FrameError("too large")
    kind, body = "", b""
    for number, value in fields(raw):
        if number in ARMS and isinstance(value, bytes):
            kind, body = ARMS[number], value
    out: dict = {"kind": kind}
    names = FIELDS.get(kind, {})
    out |= {name: b"" if name == "data" else "" for name in names.values()}
    for number, value in fields(body):
        if number in names and isinstance(value, bytes):
            name = names[number]
            try:
                out[name] = value if name == "data" else value.decode("utf-8")
            except UnicodeDecodeError as e:
                raise FrameError("text") from e
    return out


def encode_envelope(message: dict, most: int | None = None) -> bytes:
    """The envelope's bytes: fields in the order of their numbers, empty ones left out."""
    kind = message["kind"]
    body = b""
    for number, name in FIELDS[kind].items():
        value = message.get(name) or b""
        value = value.encode("utf-8") if isinstance(value, str) else bytes(value)
        if value:
            body += varint(number << 3 | 2) + varint(len(value)) + value
    arm = next(n for n, k in ARMS.items() if k == kind)
    out = varint(arm << 3 | 2) + varint(len(body)) + body
    if most is not None and len(out) > most:
        raise FrameError("too large")
    return out


def frame(payload: bytes) -> bytes:
    return struct.pack(">i", len(payload)) + payload


class FrameReader:
    """Frames from reads of any size; what is left of the last one waits for more.

    Frames before a broken length are given first; the next call raises.
    """

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.rest = most, b""

    def feed(self, raw: bytes) -> list[bytes]:
        self.rest += raw
        out, at = [], 0
        while len(self.rest) - at >= 4:
            (n,) = struct.unpack_from(">i", self.rest, at)
            if n < 0 or n > self.most:
                if out:
                    break
                raise FrameError(f"length {n}")
            if len(self.rest) - at - 4 < n:
                break
            out.append(self.rest[at + 4 : at + 4 + n])
            at += 4 + n
        self.rest = self.rest[at:]
        return out


def coalesced(frames: Iterable[bytes], most: int = 64) -> Iterator[bytes]:
    """Writes of up to so many frames each."""
    held: list[bytes] = []
    for x in frames:
        held.append(frame(x))
        if len(held) == most:
            yield b"".join(held)
            held = []
    if held:
        yield b"".join(held)
