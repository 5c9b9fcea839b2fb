"""Scalar helpers as Column expressions: topics, enums, sizes, thresholds. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEMBER_STATES = ("ALIVE", "SUSPECT", "DEAD", "LEFT")


def normalize_topic(topic: Column) -> Column:
    """Lower case, without white space at either end as the JVM defines it; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(topic, F.lit(""))), r"^\p{javaWhitespace}+|\p{javaWhitespace}+$", "")


def varint_size(n: Column) -> Column:
    """Bytes of a non-negative 32-bit varint."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5).cast("long")


def field_size(value: Column) -> Column:
    """Wire size of a string or bytes field with a one-byte tag; an empty value is left out."""
    n = F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(1 + varint_size(n) + n)


def publish_size(topic: Column, source: Column, data: Column) -> Column:
    """Wire size of an outbound publish inside its envelope."""
    inner = field_size(topic) + field_size(source) + field_size(data)
    return 1 + varint_size(inner) + inner


def member_state(text: Column) -> Column:
    """Exact name of a state, or ALIVE."""
    return F.when(text.isin(*MEMBER_STATES), text).otherwise("ALIVE")


def policy(text: Column, known: tuple[str, ...], default: str) -> Column:
    """A policy by name whatever its case and outer spaces, or the default."""
    name = F.upper(F.trim(text))
    return F.when(name.isin(*known), name).otherwise(default)


def gossip_limit(members: Column) -> Column:
    """How often a fact is sent before it retires: max(2, ceil(3 * log2(n + 1)))."""
    return F.greatest(F.lit(2).cast("long"), F.ceil(3 * F.log2(members + 1)))


def bumped_incarnation(current: Column, floor: Column) -> Column:
    return F.greatest(current, floor) + 1


def backoff_ms(attempt: Column, first: int = 1000, most: int = 30000) -> Column:
    return F.least(first * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def initiator(a: Column, b: Column) -> Column:
    """Of two nodes the lower id opens the link."""
    return F.least(a, b)


def csv_items(text: Column) -> Column:
    """Items between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def host_port(text: Column) -> tuple[Column, Column]:
    """host:port at the last colon; the port is null where it is no number."""
    return F.regexp_extract(text, r"^(.*):[^:]*$", 1), F.regexp_extract(text, r":([0-9]+)$", 1).try_cast("int")


def payload_nanos(data: Column) -> Column:
    """The number before the first colon of a payload, null without one."""
    return F.when(F.instr(data, ":") > 1, F.substring_index(data, ":", 1).try_cast("long"))


def json_row(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))
