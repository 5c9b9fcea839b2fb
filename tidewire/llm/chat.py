"""Chat formatting: link tool calls to their results, check arguments, serialise canonical JSON.

A turn's text may hold tool calls and results as JSON objects, either as the whole text or inside
<tool_call>...</tool_call> and <tool_result>...</tool_result> tags:

    call    {"id": ..., "name": ..., "arguments": {...}}
    result  {"call_id": ..., "content": ...}

Calls and results of a conversation are joined by identifier (an equi-join on conversation and identifier, so that one
conversation with many calls spreads over the tasks), and a call may name calls that it needs in "after". Events are
ordered topologically: a result after its call, a call after those it needs, otherwise by turn. Arguments are checked
against the JSON Schema of the tool's definition (keywords that aren't checked are errors of their own), which a system turn gives as {"tools": [{"name", "parameters"}]}.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, staged

TAGGED = re.compile(r"<tool_(call|result)>\s*(\{.*?\})\s*</tool_\1>", re.DOTALL)
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and without spaces, so that equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(text: str) -> float:
    if math.isfinite(x := float(text)):
        return x
    raise ValueError(text)


def _sound(value):
    """value with U+FFFD for the halves of surrogate pairs in its strings, which no UTF-8 can hold."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list):
        return [_sound(x) for x in value]
    return {_sound(k): _sound(x) for k, x in value.items()} if isinstance(value, dict) else value


def _load(text: str):
    """The JSON value; None for what isn't JSON, has numbers beyond a double's range, or nests too deep to be written again."""
    try:
        value = json.loads(text, parse_constant=_finite, parse_float=_finite)
        canonical(value)
        return _sound(value) if SURROGATE.search(text) else value
    except (ValueError, RecursionError):
        return None


def parse_turn(text: str | None) -> tuple[list[dict], list[dict], list[dict]]:
    """(calls, results, tool definitions) of one turn."""
    calls, results, tools = [], [], []
    if not text or "{" not in text:
        return calls, results, tools
    found = [(m[1], _load(m[2])) for m in TAGGED.finditer(text)]
    if not found and text.lstrip()[:1] == "{":
        found = [("", _load(text))]
    for kind, x in found:
        if not isinstance(x, dict):
            continue
        if kind != "result" and isinstance(x.get("id"), str) and isinstance(x.get("name"), str):
            calls.append(x)
        elif kind != "call" and isinstance(x.get("call_id"), str):
            results.append(x)
        elif not kind and isinstance(x.get("tools"), list):
            tools += [t for t in x["tools"] if isinstance(t, dict) and isinstance(t.get("name"), str)]
    return calls, results, tools


#: Keywords that bind values but aren't checked; each is reported as an error of its own.
UNSUPPORTED = ("$dynamicRef", "$recursiveRef", "contains", "dependencies", "dependentRequired", "dependentSchemas", "if", "patternProperties", "prefixItems", "propertyNames", "unevaluatedItems", "unevaluatedProperties")


def _referred(root, ref):
    """The schema at a pointer into the root, None if there is none."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        return None
    for part in ref[2:].split("/") if len(ref) > 1 else []:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        if isinstance(root, list):
            root = root[int(part)] if part.isdecimal() and int(part) < len(root) else None
        else:
            root = root.get(part) if isinstance(root, dict) else None
    return root if isinstance(root, (dict, bool)) else None


def _names(required) -> list[str]:
    return [x for x in required if isinstance(x, str)] if isinstance(required, list) else []


def argument_errors(arguments: str, definition: str | None) -> list[str] | None:
    """What a call's arguments break of its tool's schema; None without a definition. Never raises."""
    if definition is None:
        return None
    try:
        return schema_errors(_load(arguments), _load(definition))
    except RecursionError:
        return ["$: too deep"]


def schema_errors(value, schema, at: str = "$", root=None, refs: frozenset = frozenset()) -> list[str]:
    """What value breaks of a schema, by all keywords but UNSUPPORTED, of which it names those that the schema has."""
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return []
    root = schema if root is None else root
    errors, kind = [f"{at}: unsupported {x}" for x in UNSUPPORTED if x in schema], schema.get("type")
    kinds = kind if isinstance(kind, list) else [] if kind is None else [kind]
    if not all(isinstance(x, str) for x in kinds):
        errors, kinds = [*errors, f"{at}: unsupported type"], []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)

    def is_kind(name: str) -> bool:
        if name == "number":
            return number
        if name == "integer":
            return number and (isinstance(value, int) or value.is_integer())
        return name in TYPES and isinstance(value, TYPES[name])

    if kinds and not any(is_kind(x) for x in kinds):
        return [*errors, f"{at}: not {'|'.join(map(str, kinds))}"]
    if "$ref" in schema:
        found = _referred(root, schema["$ref"])
        if found is None or schema["$ref"] in refs:
            errors.append(f"{at}: unsupported $ref")
        else:
            errors += schema_errors(value, found, at, root, refs | {schema["$ref"]})
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        errors.append(f"{at}: const")
    for name, fits in (("allOf", None), ("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if isinstance(schema.get(name), list):
            each = [schema_errors(value, x, at, root, refs) for x in schema[name]]
            if fits is None:
                errors += [e for x in each for e in x]
            elif not fits(sum(not x for x in each)):
                errors.append(f"{at}: {name}")
    if "not" in schema:
        inner = schema_errors(value, schema["not"], at, root, refs)
        errors += [e for e in inner if ": unsupported " in e] if inner else [f"{at}: not"]
    sizes = (("Length", str), ("Items", list), ("Properties", dict))
    for suffix, of in sizes:
        for name, broken in ((f"min{suffix}", lambda b: len(value) < b), (f"max{suffix}", lambda b: len(value) > b)):
            if isinstance(value, of) and isinstance(schema.get(name), (int, float)) and broken(schema[name]):
                errors.append(f"{at}: {name}")
    if isinstance(value, str) and isinstance(schema.get("pattern"), str):
        try:
            if not re.search(schema["pattern"], value):
                errors.append(f"{at}: pattern")
        except re.error:
            errors.append(f"{at}: unsupported pattern")
    if isinstance(value, list) and schema.get("uniqueItems") is True and len(set(map(canonical, value))) < len(value):
        errors.append(f"{at}: uniqueItems")
    if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]):
        errors.append(f"{at}: not in enum")
    if number:
        for name, broken in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b), ("exclusiveMinimum", lambda b: value <= b), ("exclusiveMaximum", lambda b: value >= b), ("multipleOf", lambda b: b > 0 and Fraction(str(value)) % Fraction(str(b)) != 0)):
            if isinstance(schema.get(name), bool):
                errors.append(f"{at}: unsupported {name}")
            elif isinstance(schema.get(name), (int, float)) and broken(schema[name]):
                errors.append(f"{at}: {name}")
    if isinstance(value, dict):
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        errors += [f"{at}.{x}: missing" for x in _names(schema.get("required")) if x not in value]
        if schema.get("required") is not None and not isinstance(schema["required"], list):
            errors.append(f"{at}: unsupported required")
        for x in sorted(value):
            if x in known:
                errors += schema_errors(value[x], known[x], f"{at}.{x}", root)
            elif schema.get("additionalProperties") is False:
                errors.append(f"{at}.{x}: unexpected")
            else:
                errors += schema_errors(value[x], schema.get("additionalProperties"), f"{at}.{x}", root)
    if isinstance(value, list):
        for i, x in enumerate(value):
            errors += schema_errors(x, schema.get("items"), f"{at}[{i}]", root)
    return errors


def topological(n: int, needs: dict[int, set[int]]) -> list[int]:
    """Of 0 to n - 1 the order that puts each after its needs and else keeps the numbers; members of cycles come last, by number."""
    waits = {i: len(needs.get(i, ())) for i in range(n)}
    after = defaultdict(list)
    for i, before in needs.items():
        for j in before:
            after[j].append(i)
    ready, out = [i for i in range(n) if not waits[i]], []
    heapq.heapify(ready)
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    return out + sorted(set(range(n)) - set(out))


EVENT = "conv_id long, turn long, role string, seq long, kind string, event_id string, name string, body string, needs array<string>, has_tools boolean"


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per call, result and tool definition, and one per turn as it stands (kind "turn")."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("event_id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("needs", pa.list_(pa.string())), ("has_tools", pa.bool_())])
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
            calls, results, tools = parse_turn(text)
            rows.append((conv, turn, role, 0, "turn", None, None, text, None, bool(calls or results or tools)))
            for i, x in enumerate(calls):
                after = x.get("after")
                needs = sorted({y for y in after if isinstance(y, str)}) if isinstance(after, list) else []
                rows.append((conv, turn, role, i + 1, "call", x["id"], x["name"], canonical(x.get("arguments")), needs, True))
            for i, x in enumerate(results):
                rows.append((conv, turn, role, len(calls) + i + 1, "result", x["call_id"], None, canonical(x.get("content")), None, True))
            rows += [(conv, turn, role, 0, "tool", None, x["name"], canonical(x.get("parameters")), None, True) for x in tools]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def linked_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, links). links has one row per call: its first result in or after its turn, its definition and schema errors."""
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    events = staged(rows.mapInArrow(_events, EVENT), "chat-events")
    order = Window.partitionBy("conv_id", "event_id").orderBy("turn", "seq", "body")
    calls = events.where("kind = 'call'").withColumn("nth", F.row_number().over(order))
    results = events.where("kind = 'result'").withColumn("nth", F.row_number().over(order)).select("conv_id", "event_id", "nth", F.col("turn").alias("r_turn"), F.col("body").alias("result"))
    # a definition holds from its turn to the next one's
    at = F.coalesce("turn", F.lit(-(1 << 63)))
    tools = events.where("kind = 'tool'").groupBy("conv_id", "name", at.alias("since")).agg(F.max_by("body", F.struct("seq", "body")).alias("definition"))
    tools = tools.withColumn("until", F.lead("since").over(Window.partitionBy("conv_id", "name").orderBy("since")))
    linked = calls.join(results, ["conv_id", "event_id", "nth"], "left").alias("c")
    holds = (F.col("c.conv_id") == F.col("t.conv_id")) & (F.col("c.name") == F.col("t.name")) & (at >= F.col("since")) & (F.col("until").isNull() | (at < F.col("until")))
    linked = linked.join(tools.alias("t"), holds, "left").select("c.*", "definition")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [argument_errors(a, d) for a, d in zip(batch.column("body").to_pylist(), batch.column("definition").to_pylist(), strict=True)]
            yield batch.append_column("errors", pa.array(errors, pa.list_(pa.string())))

    columns = ["conv_id", "event_id", "nth", "turn", "seq", "name", "body", "needs", "r_turn", "result", "definition"]
    schema = "conv_id long, event_id string, nth int, turn long, seq long, name string, body string, needs array<string>, r_turn long, result string, definition string, errors array<string>"
    return events, linked.select(*columns).mapInArrow(check, schema)


def numbered(turns: DataFrame) -> DataFrame:
    """Adds line, the number of a turn in its conversation from 0, by turn, role and a hash of the text.

    Turns are dealt by ranges of that order, so a conversation of many turns spreads over the tasks; the numbers are
    counted in each range and start at the count of the ranges before, of which there are no more rows than ranges.
    """
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.xxhash64("text").asc()]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(turns.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()), "chat-turns")
    counts = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("o_conv"), F.col("range").alias("o_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "range").orderBy(*by[1:], "text")
    lines = dealt.withColumn("place", F.row_number().over(within) - 1).join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("range") == F.col("o_range")))
    return lines.withColumn("line", (F.col("place") + F.col("before")).cast("int")).select(*turns.columns, "line")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, turn, role, position (in the topological order, from 0), n_calls, n_linked, n_invalid, n_orphans, message.

    message is the canonical JSON of the turn: role, content, and its calls with their results. A turn with a result
    comes after the turn of its call, whatever its number; a turn with a call comes after the turns of the calls that
    it names in "after". Only conversations in which that differs from the order of the turns are reordered in Python,
    one at a time by the (few) turns that hold events; all others keep a window's row number.

    Nulls: rows of a null conv_id are ordered together and a null turn comes first, but calls and results there are
    left unlinked; a null role or text is null in the JSON. Repeated turns stand side by side, ordered by role and
    a hash of the text, and each shows the calls of all. A result without a call is an orphan; of repeated
    identifiers the n-th result belongs to the n-th call. Arguments are checked against the last definition of the tool
    at or before the call; without one they are not checked. What isn't strict JSON (numbers beyond a double's range,
    NaN, nesting too deep to write) is content and no call; halves of surrogate pairs become U+FFFD. Texts of any length
    are read whole. An empty table gives no rows; other columns are never read.
    """
    events, links = linked_calls(conversations)
    links = staged(links, "chat-links")
    call = F.struct("event_id", "name", "body", "result", F.size(F.coalesce("errors", F.array())).alias("bad"), "errors", "seq")
    per_turn = links.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("seq", call.alias("call")))).alias("calls"),
        F.count("result").alias("n_linked"),
        F.count(F.when(F.size("errors") > 0, 1)).alias("n_invalid"),
    )
    results = events.where("kind = 'result'").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_results"))
    got = links.where(F.col("result").isNotNull()).groupBy("conv_id", F.col("r_turn").alias("turn")).agg(F.count(F.lit(1)).alias("n_got"))
    orphans = results.join(got, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("n_results") - F.coalesce("n_got", F.lit(0))).alias("n_orphans"))
    turns = numbered(events.where("kind = 'turn'").select("conv_id", "turn", "role", F.col("body").alias("text")))
    full = turns.join(per_turn, ["conv_id", "turn"], "left").join(orphans, ["conv_id", "turn"], "left")

    # edges between turns of one conversation that contradict the turns' order
    named = links.select("conv_id", "turn", F.explode("needs").alias("event_id"))
    first = links.groupBy("conv_id", "event_id").agg(F.min("turn").alias("b_turn"))
    edges = named.join(first, ["conv_id", "event_id"]).select("conv_id", F.col("b_turn").alias("before"), F.col("turn").alias("after"))
    edges = edges.unionByName(links.where(F.col("result").isNotNull()).select("conv_id", F.col("turn").alias("before"), F.col("r_turn").alias("after"))).where("before <> after").distinct()
    broken = edges.where("before > after").select("conv_id").distinct()
    needed = edges.join(broken, "conv_id", "left_semi").groupBy("conv_id").agg(F.collect_list(F.struct("before", "after")).alias("edges"))
    moved = turns.join(broken, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("line", "turn"))).alias("lines")).join(needed, "conv_id")

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, lines, pairs in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "lines", "edges")], strict=True):
                by_turn = defaultdict(list)
                for i, x in enumerate(lines):
                    by_turn[x["turn"]].append(i)
                needs = defaultdict(set)
                for e in pairs:
                    for j in by_turn[e["after"]]:
                        needs[j] |= set(by_turn[e["before"]])
                position = {j: p for p, j in enumerate(topological(len(lines), needs))}
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(lines), pa.int64()), pa.array([x["line"] for x in lines], pa.int32()), pa.array([position[i] for i in range(len(lines))], pa.int32())], ["conv_id", "line", "position"])

    places = moved.mapInArrow(reorder, "conv_id long, line int, position int")
    full = full.join(places, ["conv_id", "line"], "left")

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for role, text, calls in zip(*[batch.column(c).to_pylist() for c in ("role", "text", "calls")], strict=True):
                message = {"role": role, "content": text}
                if calls:
                    message["tool_calls"] = [{"id": x["event_id"], "name": x["name"], "arguments": _load(x["body"]), "result": _load(x["result"]) if x["result"] is not None else None, "errors": x["errors"] or []} for x in (c["call"] for c in calls)]
                out.append(canonical(message))
            keep = [batch.column(c) for c in ("conv_id", "turn", "role", "position", "n_calls", "n_linked", "n_invalid", "n_orphans")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.string())], ["conv_id", "turn", "role", "position", "n_calls", "n_linked", "n_invalid", "n_orphans", "message"])

    zero = F.lit(0).cast("long")
    ready = full.select("conv_id", "turn", "role", F.coalesce("position", "line").cast("int").alias("position"), F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_invalid", zero).alias("n_invalid"), F.coalesce("n_orphans", zero).alias("n_orphans"), "text", "calls")
    ready = ready.withColumn("n_calls", F.greatest("n_calls", zero))
    return ready.mapInArrow(serialise, "conv_id long, turn long, role string, position int, n_calls long, n_linked long, n_invalid long, n_orphans long, message string")
