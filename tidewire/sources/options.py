"""Options with the reference's precedence: environment over the first properties file by name over defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class StreamOptions:
    max_frame: int = 512
    drop_unknown: bool = True
    max_connections: int = 0
    queue_capacity: int = 1024
    backpressure: str = "DISCONNECT_SLOW_CONSUMER"
    window: int = 4096
    replay_capacity: int = 65536
    offer_timeout_ms: int = 5000
    seeds: str = ""


def properties(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip()
    return out


def first_file(folder: str | Path) -> dict[str, str]:
    """The properties of the first *.properties file by lower-cased name."""
    found = sorted(Path(folder).glob("*.properties"), key=lambda p: p.name.lower()) if Path(folder).is_dir() else []
    return properties(found[0].read_text()) if found else {}


def options(env: Mapping[str, str], folder: str | Path = "config") -> StreamOptions:
    """max_frame is MAX_FRAME in the environment and max-frame in a file."""
    file, chosen = first_file(folder), {}
    for f in fields(StreamOptions):
        raw = env.get(f.name.upper(), file.get(f.name.replace("_", "-")))
        if raw is not None:
            kind = type(f.default)
            chosen[f.name] = raw.strip().lower() == "true" if kind is bool else kind(raw)
    return StreamOptions(**chosen)
