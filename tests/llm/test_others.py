"""Vectors, chats and the pipeline."""

import json
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from tidewire.llm import chat, topk

VECTORS = "vec_id long, embedding array<float>, label int, uid string, score string"


def brute_top(rows, k=20, every=20):
    q = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, v) in enumerate(q):
        if i is not None and i % every == 0:
            found = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(q) if b != a))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(8192, 1024, 1 << 25), (37, 3, 1 << 25), (37, 3, 0)])
def test_top_k(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "MOST_BROADCAST", blocks[2])
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(300 + i, [0.5] * 8) for i in range(60)] + [(20, rows[20][1]), (None, [1.0] * 8), (400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [float("inf")] * 8), (404, []), (420, [1e3] * 3)]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], VECTORS)
    got = topk.top_k(df, candidates=blocks[0], queries=blocks[1]).collect()
    assert sorted(map(tuple, got), key=repr) == brute_top(rows)
    assert topk.top_k(df.where("false")).collect() == []


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(0, [6e10, 1.0]), (1, [6e10, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ArithmeticError):
        topk.top_k(df)


def test_large_components_stay_exact():
    v = np.array([[2**28, 3], [2**28 - 1, 5], [7, 2**29]])
    one = (np.arange(3), np.arange(3), np.zeros(3, np.int8), v, (v.astype(float) ** 2).sum(1), np.zeros((3, 0)))
    for uid, _, ids, _, scores in topk.search_block(one, one, 2):
        assert scores.tolist() == sorted((int(v[uid] @ v[j]) for j in range(3) if j != uid), reverse=True) and len(ids) == 2


CALL = '<tool_call>{"id": "%s", "name": "add", "arguments": %s%s}</tool_call>'
RESULT = '<tool_result>{"call_id": "%s", "content": %s}</tool_result>'
TOOLS = json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}]})


def test_chats(spark):
    rows = [
        (1, 0, "system", TOOLS),
        (1, 1, "user", "hello"),
        (1, 2, "assistant", CALL % ("x", '{"b": 2, "a": 1}', "") + CALL % ("y", '{"a": -1}', "")),
        (1, 3, "tool", RESULT % ("x", "3") + RESULT % ("nobody", "null")),
        (2, 0, "tool", RESULT % ("z", '"early"')),
        (2, 1, "assistant", CALL % ("z", "{}", "")),
        (2, 2, "assistant", CALL % ("late", "{}", ', "after": ["last"]')),
        (2, 3, "assistant", CALL % ("last", "{}", "")),
        (3, 0, None, None),
        (3, 0, None, None),
        (None, None, "user", "{broken"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, event_id string")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    message = json.loads(by[1, 2].message)
    assert [c["id"] for c in message["tool_calls"]] == ["x", "y"]
    assert message["tool_calls"][0]["result"] == 3 and message["tool_calls"][0]["errors"] == ["$.b: unexpected"]
    assert message["tool_calls"][1]["result"] is None and message["tool_calls"][1]["errors"] == ["$.a: minimum"]
    assert (by[1, 2].n_calls, by[1, 2].n_linked, by[1, 2].n_invalid, by[1, 3].n_orphans) == (2, 1, 2, 1)
    assert by[1, 2].message == chat.canonical(message)
    order = [t for _, t in sorted((r.position, r.turn) for r in got if r.conv_id == 2)]
    assert order == [1, 0, 3, 2]
    assert by[None, None].message == '{"content":"{broken","role":"user"}'
    assert chat.format_chats(df.where("false")).collect() == []


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"pattern": "^a+$"}, "aa", "ab"),
        ({"const": {"a": 1}}, {"a": 1}, {"a": 2}),
        ({"minLength": 2, "maxLength": 3}, "abc", "a"),
        ({"minItems": 1, "maxItems": 2}, [1], [1, 2, 3]),
        ({"uniqueItems": True}, [1, 2], [1, 1]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, 2, 3),
        ({"multipleOf": 0.1}, 0.3, 0.25),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 3, 2),
        ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, 4),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, 2, 4),
        ({"not": {"type": "null"}}, 1, None),
        ({"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}}}, "$ref": "#/$defs/n"}, {"next": {"v": 1}}, {"next": {"next": {"v": "x"}}}),
        ({"additionalProperties": {"type": "integer"}}, {"a": 1}, {"a": "x"}),
    ],
)
def test_schema_keywords(schema, good, bad):
    assert chat.schema_errors(good, schema) == [] and len(chat.schema_errors(bad, schema)) == 1
    assert chat.schema_errors(1, {"if": {}}) == ["$: unsupported if"] and chat.schema_errors(1, {"$ref": "#"}) == ["$: unsupported $ref"]


HOSTILE = ["1e999", '"\\\\ud800"', "[" * 3000 + "]" * 3000, "9" * 400, "NaN", '{"\\\\udc00": 1}', "-1e400"]


def test_hostile_json(spark):
    hostile = [x.replace("\\\\", "\\") for x in HOSTILE]
    schemas = ['{"type": "integer"}', '{"required": true}', '{"required": [["x"]]}', '{"type": {"a": 1}}', '{"type": [{}]}', '{"properties": 3, "items": 4, "enum": 5, "allOf": [1]}', '{"type": "object", "required": ["a"]}']
    rows = [(1, 0, "system", '{"tools": [%s]}' % ", ".join(f'{{"name": "s{i}", "parameters": {x}}}' for i, x in enumerate(schemas)))]
    rows += [(1, 1 + 10 * i + j, "assistant", '<tool_call>{"id": "c%d", "name": "s%d", "arguments": %s}</tool_call>' % (10 * i + j, j, x if x[0] == "{" else '{"v": %s}' % x)) for i, x in enumerate(hostile) for j in range(len(schemas))]
    rows += [(1, 200 + i, "assistant", '{"id": %s, "name": "s0", "arguments": {}}' % x) for i, x in enumerate(hostile)]
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert got[1].n_calls == 0 and json.loads(got[1].message)["content"] == rows[1][3]  # a number beyond a double's range
    assert got[31].n_invalid == 1 and got[37].n_invalid == 1 and "9" * 400 in got[31].message
    assert json.loads(got[11].message)["tool_calls"][0]["arguments"] == {"v": "\ufffd"} and got[201].n_calls == 1
    assert chat.schema_errors(10**400, {"type": "integer"}) == [] and chat.schema_errors({}, {"required": [["x"], "y"]}) == ["$.y: missing"]


def test_calls_against_a_plain_loop(spark):
    """Thousands of turns, most in one conversation; repeated identifiers, results too early, definitions that change."""
    rng = np.random.default_rng(7)
    rows = []
    for t in range(4000):
        conv = 1 if t % 8 else int(rng.integers(2, 6))
        kind, name, ident = rng.integers(0, 5), f"f{rng.integers(0, 3)}", f"i{rng.integers(0, 1200)}"
        if kind == 0 and t % 5 == 0:
            rows.append((conv, t, "system", json.dumps({"tools": [{"name": name, "parameters": {"properties": {"a": {"maximum": int(rng.integers(0, 9))}}}}]})))
        elif kind <= 2:
            rows.append((conv, t, "assistant", CALL.replace("add", name) % (ident, json.dumps({"a": int(rng.integers(0, 9))}), "")))
        elif kind == 3:
            rows.append((conv, t, "tool", RESULT % (ident, t)))
        else:
            rows.append((conv, t, "user", f"words {t}"))
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()}
    calls, results, tools = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, t, _, x in rows:
        found = chat.parse_turn(x)
        for y in found[0]:
            calls[c, y["id"]].append((t, y))
        for y in found[1]:
            results[c, y["call_id"]].append((t, y))
        for y in found[2]:
            tools[c, y["name"]].append((t, y["parameters"]["properties"]["a"]["maximum"]))
    linked, invalid, after, n_calls = defaultdict(int), defaultdict(int), [], defaultdict(int)
    answered = defaultdict(int)
    for (c, ident), each in calls.items():
        for k, (t, y) in enumerate(each):
            n_calls[c, t] += 1
            mosts = [m for at, m in tools[c, y["name"]] if at <= t]
            invalid[c, t] += bool(mosts) and y["arguments"]["a"] > mosts[-1]
            if k < len(results[c, ident]):
                linked[c, t] += 1
                answered[c, results[c, ident][k][0]] += 1
                after.append((c, t, results[c, ident][k][0]))
    for c, t, _, x in rows:
        r = got[c, t]
        assert (r.n_calls, r.n_linked, r.n_invalid, r.n_orphans) == (n_calls[c, t], linked[c, t], invalid[c, t], len(chat.parse_turn(x)[1]) - answered[c, t])
    assert sum(invalid.values()) > 100 and sum(answered.values()) > 100
    for c in {r[0] for r in rows}:
        assert sorted(r.position for k, r in got.items() if k[0] == c) == list(range(sum(r[0] == c for r in rows)))
    assert all(got[c, a].position < got[c, b].position for c, a, b in after)


def test_topological():
    assert chat.topological(4, {0: {3}, 2: {0}}) == [1, 3, 0, 2]
    assert chat.topological(3, {0: {1}, 1: {0}}) == [2, 0, 1]


def test_pipeline_stages(spark, sf_dir):
    """Each stage against plain Python on its own input."""
    import corpus_pipeline as p
    from tests.llm.test_documents import brute_components
    from tidewire.llm import mixing, quality_classifier, secrets
    from tidewire.llm.common import staged

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, outputs = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = staged(stage(spark, docs, sf_dir), name)
        outputs[name] = docs
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
        rows = before.orderBy("doc_id").collect()
        if name == "quality_classifier":
            scored = {r.doc_id: r.predicted for r in quality_classifier.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in rows if scored[r.doc_id]}
        elif name == "minhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in rows])}
        elif name == "secret_scan":
            after = {r.doc_id: r.text for r in docs.collect()}
            for r in rows:
                base, more, _ = secrets.scan_text(r.text)
                assert after[r.doc_id] == (secrets.redact(r.text, base + more) if base or more else r.text)
        elif name == "source_mix":
            taken = defaultdict(int)
            for r in docs.collect():
                taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert {i: n for i, n in taken.items() if n} == {r.doc_id: r.taken for r in mixing.mix_sources(before).collect() if r.taken}
        else:
            fills = defaultdict(int)
            for r in docs.collect():
                fills[r.sequence_id] += r.length
            assert max(fills.values()) <= 2048 and len(fills) <= sum(fills.values()) / 2048 * 1.02 + 2
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in rows}
            packed, sequences = docs.orderBy("sequence_id", "offset").collect(), defaultdict(list)
            for r in packed:
                assert r.offset == len(sequences[r.sequence_id]) and r.length == len(r.ids)
                sequences[r.sequence_id] += r.ids
            assert sum(map(len, sequences.values())) == sum(r.length for r in packed)
    assert p.run(spark, sf_dir).count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path, docs_of, odd):
    import corpus_pipeline as p

    rows = [*odd, (None, "a b c d e f"), (9, "token=abcdef99 " * 3), (9, "token=abcdef99 " * 3), (10, None, None)]
    for name, given in (("odd", rows), ("none", [])):
        docs = docs_of([r[:2] for r in given], extra=True)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = p.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == bool(given) and all(len(r.ids) == r.length for r in out)
