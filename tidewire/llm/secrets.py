"""Secret scans with a recursive decoding worklist.

Each text is layer 0. A layer is scanned by the detectors and searched for encoded runs (URL escapes, Unicode and
HTML escapes, base64, and compressed bytes inside base64 or hex); each run that decodes is a new layer, with a map
from its characters back to the text. The worklist ends at the fixpoint: a layer whose content was already unwrapped
at the same place is not queued again, so cycles end. A cheap RE2 pass over each Arrow batch finds the texts that hold
anything to look at; only those reach Python's regular expressions.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed detectors of the contract: name, pattern, group whose length counts, least length.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Texts without any of these hold no secret in any layer: each decoder's shortest unit or run matches. The shortest
#: secret is an assignment of 12 characters (token=abcdef), 16 in base64 and 24 in hex.
HINT = r"""(?i:passw(?:or)?d|secret|token|api_?key|%[0-9a-f]{2}|\\u\{[0-9a-f]{1,6}\}|\\u[0-9a-f]{4}|\\x[0-9a-f]{2}|&#x?[0-9a-f]+;)|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}"""

URL_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_UNIT = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that go on over line breaks; lines may be indented. The padding ends it.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]++)+={0,2}")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LEAST_BASE64 = 16
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")

#: A compressed layer larger than this is scanned in windows of this size and the text is flagged, as encoded runs longer
#: than the overlap may be cut.
MOST_INFLATED, OVERLAP = 64 << 20, 1 << 20
WHOLE, WINDOW, OPEN = range(3)
#: Layers of escapes that are unwrapped and scanned one by one.
ESCAPED = 8


@dataclass(slots=True)
class Layer:
    text: str
    start: np.ndarray | int | None  # per character its place in layer 0; one place for all; None: its own
    end: np.ndarray | int | None
    via: str
    escaped: int = 0  # layers of escapes that led here

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        if isinstance(self.start, int):
            return self.start, self.end
        return int(self.start[a]), int(self.end[b - 1])

    def spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in layer 0 of the characters from a to b."""
        if self.start is None:
            return np.arange(a, b), np.arange(a + 1, b + 1)
        return self.start[a:b], self.end[a:b]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three detectors, by start and then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\n\r\t" for c in text)
    return text if text and good >= 0.95 * len(text) else None


class _Zlib:
    """zlib's decompressor with the interface of bz2's and lzma's."""

    def __init__(self, bits: int) -> None:
        self.worker, self.tail = zlib.decompressobj(bits), b""

    def decompress(self, raw: bytes, most: int) -> bytes:
        out = self.worker.decompress(self.tail + raw, most)
        self.tail = self.worker.unconsumed_tail
        return out

    @property
    def eof(self) -> bool:
        return self.worker.eof

    @property
    def unused_data(self) -> bytes:
        return self.worker.unused_data

    @property
    def needs_input(self) -> bool:
        return not self.tail


def _decompressor(raw: bytes):
    """(a new decompressor, if members may follow) by the first bytes; None for other bytes."""
    if raw[:2] == b"\x1f\x8b":
        return _Zlib(31), True
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor(), True
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), True
    if len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return _Zlib(15), False
    return None


def _inflate(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """Bytes of a compressed stream (all members), WHOLE, or OPEN if it ends too early, or in several parts as WINDOW; nothing for other bytes."""
    if (found := _decompressor(raw)) is None:
        return
    (worker, several), feed, held, state, some = found, raw, b"", WHOLE, False
    while True:
        try:
            piece = worker.decompress(feed, MOST_INFLATED - len(held))
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            if some:
                yield held, max(state, OPEN if state == WHOLE else WINDOW)
            return
        feed, some, held = b"", some or worker.eof, held + piece
        if worker.eof:
            feed = worker.unused_data
            if several and (found := _decompressor(feed)) and found[1]:
                worker = found[0]
            else:
                yield held, state
                return
        elif len(held) < MOST_INFLATED and not piece and worker.needs_input:
            if held:
                yield held, OPEN if state == WHOLE else WINDOW
            return
        if len(held) >= MOST_INFLATED:
            state, some = WINDOW, True
            yield held, state
            held = held[-min(OVERLAP, MOST_INFLATED // 2) :]


def _unit(token: str) -> str:
    if token[0] == "&":
        return html.unescape(token)
    digits = token[2:].strip("{}")
    code = int(digits, 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else token


def _escapes(layer: Layer, unit: re.Pattern, decode, via: str) -> Layer | None:
    """The layer with its escaped units decoded; each character keeps its place in layer 0."""
    fixed = isinstance(layer.start, int)
    text, starts, ends, at = [], [], [], 0
    for m in unit.finditer(layer.text):
        plain = decode(m[0])
        text += [layer.text[at : m.start()], plain]
        if not fixed:
            (a, b), (same_a, same_b) = layer.span(m.start(), m.end()), layer.spans(at, m.start())
            starts += [same_a, np.full(len(plain), a)]
            ends += [same_b, np.full(len(plain), b)]
        at = m.end()
    text.append(layer.text[at:])
    out = "".join(text)
    if not out or out == layer.text:
        return None
    if fixed:
        return Layer(out, layer.start, layer.end, via, layer.escaped + 1)
    same_a, same_b = layer.spans(at, len(layer.text))
    return Layer(out, np.concatenate([*starts, same_a]), np.concatenate([*ends, same_b]), via, layer.escaped + 1)


HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
UNICODE_END = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")


def _closed(out: list[str]) -> int:
    """Characters of the unit that ends out, or 0."""
    last = out[-1]
    if last in HEX_DIGITS:
        for size, head in ((3, "%"), (4, "\\x"), (6, "\\u")):
            if len(out) >= size and "".join(out[-size : len(head) - size]) == head and HEX_DIGITS.issuperset(out[len(head) - size :]):
                return size
    elif last in "};" and (m := UNICODE_END.search("".join(out[-10:]))):
        return m.end() - m.start()
    return 0


def _collapsed(layer: Layer, via: str) -> Layer | None:
    """The layer at the fixpoint of its escapes: one pass from the left, in which what a unit gives may end another unit."""
    out, starts, ends = [], [], []
    fixed = isinstance(layer.start, int)
    a, b = ([0] * len(layer.text),) * 2 if fixed else (x.tolist() for x in layer.spans(0, len(layer.text)))
    for c, x, y in zip(layer.text, a, b, strict=True):
        out.append(c)
        starts.append(x)
        ends.append(y)
        while size := _closed(out):
            token, x = "".join(out[-size:]), starts[-size]
            plain = bytes([int(token[1:], 16)]).decode("ascii", "surrogateescape") if token[0] == "%" else _unit(token)
            if plain == token:
                break
            out[-size:], starts[-size:], ends[-size:] = list(plain), [x] * len(plain), [y] * len(plain)
    text, at, places = [], 0, ([], [])
    for m in re.finditer(r"[\udc80-\udcff]+|[^\udc80-\udcff]+", "".join(out)):
        raw = m[0]
        if "\udc80" <= raw[0] <= "\udcff":  # bytes of escaped UTF-8
            raw = raw.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            places[0].append(np.full(len(raw), starts[at]))
            places[1].append(np.full(len(raw), ends[m.end() - 1]))
        else:
            places[0].append(np.array(starts[at : m.end()]))
            places[1].append(np.array(ends[at : m.end()]))
        text.append(raw)
        at = m.end()
    plain = "".join(text)
    if not plain or plain == layer.text:
        return None
    return Layer(plain, *((layer.start, layer.end) if fixed else map(np.concatenate, places)), via, layer.escaped + 1)


def _url(token: str) -> str:
    return binascii.unhexlify(token.replace("%", "")).decode("utf-8", "replace")


def _packed(layer: Layer, a: int, b: int, raw: bytes, via: str) -> Iterator[tuple[Layer, int]]:
    place, plain = layer.span(a, b), True
    for part, state in _inflate(raw):
        plain = False
        text = part.decode("utf-8", "replace") if state == WINDOW else _readable(part if state == WHOLE else part.decode("utf-8", "ignore").encode())
        if text:
            yield Layer(text, *place, f"{via}.zip"), state
    if plain and (text := _readable(raw)):
        yield Layer(text, *place, via), WHOLE


def _base64(run: str) -> bytes | None:
    run = run.replace("-", "+").replace("_", "/")
    return base64.b64decode(run + "=" * (-len(run) % 4)) if len(run) % 4 != 1 else None


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of base64 that may be wrapped: lines of one width, with the shorter line after them and without, and with the line before them and without."""
    for m in BASE64_LINES.finditer(text):
        lines = [x.span() for x in BASE64_LINE.finditer(text, *m.span())]
        width = [b - a for a, b in lines]
        if max(width) < LEAST_BASE64:
            continue
        first = 0
        while first < len(lines):
            last = first + 1
            while last < len(lines) and width[last] == width[first]:
                last += 1
            if width[first] >= LEAST_BASE64:
                for a in (first - 1, first) if first else (first,):
                    for b in (last, last + 1) if last < len(lines) and width[last] < width[first] else (last,):
                        if b - a > 1:
                            end = m.end() if b == len(lines) else lines[b - 1][1]
                            yield lines[a][0], end, "".join(text[x:y] for x, y in lines[a:b])
            first = last


def _children(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    prefix = f"{layer.via}." if layer.via else ""
    if layer.escaped >= ESCAPED:
        if layer.escaped == ESCAPED and ("%" in layer.text or "\\" in layer.text or "&#" in layer.text) and (child := _collapsed(layer, f"{prefix}nested")):
            yield child, False
    elif "%" in layer.text and (child := _escapes(layer, URL_UNIT, _url, f"{prefix}url")):
        yield child, False
    if layer.escaped < ESCAPED and ("\\" in layer.text or "&#" in layer.text) and (child := _escapes(layer, UNICODE_UNIT, _unit, f"{prefix}unicode")):
        yield child, False
    whole: list[tuple[int, int]] = []
    open_ended: list[tuple[int, int, Layer]] = []
    for a, b, run in [*wrapped(layer.text), *((m.start(), m.end(), m[0].rstrip("=")) for m in BASE64_RUN.finditer(layer.text))]:
        raw = _base64(run)
        if raw is None:
            continue
        for child, state in _packed(layer, a, b, raw, f"{prefix}base64"):
            if state == OPEN:
                open_ended.append((a, b, child))
            else:
                whole.append((a, b))
                yield child, state == WINDOW
    # part of a stream that another choice of lines has read to its end is not incomplete
    for a, b, child in open_ended:
        if not any(x <= a and b <= y for x, y in whole):
            yield child, True
    for m in HEX_RUN.finditer(layer.text):
        for child, state in _packed(layer, m.start(), m.end(), binascii.unhexlify(m[0]), f"{prefix}hexed"):
            yield child, state != WHOLE


def scan_places(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], set[tuple[int, int]]]:
    """Base spans, spans that decoded layers add (kind is the layers, then the detector), and the places of layers in windows or without end."""
    base = base_spans(text)
    known, added = set(base), set()
    seen, guarded = set(), set()

    def walk(start: Layer) -> None:
        queue = deque([start])
        while queue:
            layer = queue.popleft()
            for child, cut in _children(layer):
                place = child.span(0, len(child.text))
                if cut:
                    guarded.add(place)
                key = (hashlib.blake2b(child.text.encode("utf-8", "replace"), digest_size=16).digest(), place)
                if key in seen:
                    continue
                seen.add(key)
                for a, b, kind in base_spans(child.text):
                    at = child.span(a, b)
                    if (*at, kind) not in known:
                        known.add((*at, kind))
                        added.add((*at, f"{child.via}.{kind}"))
                if cut:
                    walk(child)  # one window is held at a time
                else:
                    queue.append(child)

    walk(Layer(text, None, None, ""))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(added, key=lambda x: (x[0], order.get(x[2], 9), x[2], x[1])), guarded


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], bool]:
    """As scan_places, with only if there are such layers."""
    base, added, guarded = scan_places(text)
    return base, added, bool(guarded)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each maximal union of spans replaced by mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _scan(redacted: bool):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            hits = pc.match_substring_regex(texts, HINT)
            counts, digests, spans, guards, plain = [[], [], []], [], [], [], []
            for hit, text in zip(hits.to_pylist(), texts, strict=True):
                base, more, guarded = scan_places(text.as_py()) if hit else ([], [], set())
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else empty)
                both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else 9, x[2], x[1]))
                spans.append(joined(both))
                guards.append(bool(guarded))
                if redacted:
                    plain.append(redact(text.as_py(), [*both, *((*x, "") for x in guarded)]) if both or guarded else None)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(guards, pa.bool_())]
            names = ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "guarded"]
            if redacted:
                columns, names = [*columns, pa.array(plain, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def scan(docs: DataFrame, key: Column, *, redacted: bool = False) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans, guarded; and the text without its secrets, null if it has none."""
    keyed = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, guarded boolean" + ", redacted string" * redacted
    return keyed.mapInArrow(_scan(redacted), schema)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, guarded.

    A null text is scanned as the empty text and has no spans; repeated rows are scanned each; a null doc_id is kept. A
    text of any length is scanned whole; its layers take some twenty times its size while it is. An empty table gives no
    rows; other columns are never read.
    `guarded` is true where a compressed layer was larger than MOST_INFLATED and scanned in windows, or its stream ended
    too early and was scanned to there.
    """
    return scan(docs, F.col("doc_id")).withColumnRenamed("key", "doc_id")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every secret and every guarded layer in its text replaced by "[secret]", n_chars following; all other columns stay.

    A null or empty text stays as it is; repeated rows are redacted each; other columns may have any names and types. An
    empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(whole.alias("rest"), F.col("text").alias("text"))
    schema = rows.schema

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            hits = pc.match_substring_regex(texts, HINT).to_pylist()
            out = batch.column(1).to_pylist()
            for i, hit in enumerate(hits):
                if hit:
                    base, more, guarded = scan_places(out[i])
                    if base or more or guarded:
                        out[i] = redact(out[i], [*base, *more, *((*x, "") for x in guarded)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["rest", "text"])

    done = rows.mapInArrow(run, schema)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("text").isNull(), F.col(f"rest.`{c}`")).otherwise(F.length("text").cast("long")).alias(c))
        else:
            columns.append(F.col(f"rest.`{c}`").alias(c))
    return done.select(*columns)
