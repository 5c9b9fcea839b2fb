"""Numbers and gaps by ranges, against plain Python on keys that cross many ranges."""

import random

import pytest

from tidewire.operators import sequencing


@pytest.fixture(scope="module")
def held():
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 400)]), i) for i in range(900)]
    return [*rows, *[("hot", i, i) for i in range(300) if i % 7]]


@pytest.mark.parametrize("span", [1, 10, 64, 1 << 20])
def test_numbers_by_ranges(spark, held, span, monkeypatch):
    df = spark.createDataFrame(held, "k string, at long, tie int").repartition(5)
    expected, last = [], {}
    for k, at, tie in sorted(held, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        last[k] = last.get(k, 0) + 1
        expected.append((k, at, tie, last[k]))
    monkeypatch.setattr(sequencing, "ONE_TASK", -1)
    found = sequencing.number(df, ["k"], ["at", "tie"], "n", span)
    assert found.columns == ["k", "at", "tie", "n"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert sequencing.number(df.where("false"), ["k"], ["at"], "n", span).collect() == []


@pytest.mark.parametrize("span", [1, 10, 1 << 20])
def test_gaps_and_frontier_by_ranges(spark, span, monkeypatch):
    monkeypatch.setattr(sequencing, "ONE_TASK", -1)
    monkeypatch.setattr(sequencing, "SPAN", span)
    seqs = {"a": [1, 2, 3, 9, 10, 45, 46], "b": [2, 3], "c": [*range(1, 31)]}
    df = spark.createDataFrame([(k, s) for k, v in seqs.items() for s in [*v, v[0]]], "k string, seq long")
    gaps = {(k, a + 1, b - 1) for k, v in seqs.items() for a, b in zip(v, v[1:], strict=False) if b - a > 1}
    assert set(map(tuple, sequencing.gaps(df, ["k"]).collect())) == gaps
    assert set(map(tuple, sequencing.frontiers(df, ["k"]).collect())) == {("a", 3), ("b", 0), ("c", 30)}
