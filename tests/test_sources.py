"""Frames and envelopes: round trips, rejection, partial reads, Spark readers and writers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.sources import authentication, formats, framing
from tidewire.sources.options import options

TEXTS = ["", "a", "topic.eu", "x" * 300, "é", "日本", "😀"]
DATA = [b"", b"x", bytes(range(256)), b"\xff\xfe", b"y" * 300]


@pytest.mark.parametrize("topic", TEXTS)
@pytest.mark.parametrize("data", DATA)
def test_round_trip(topic, data):
    m = {"kind": "publish_inbound", "topic": topic, "source": "s", "token": "", "data": data}
    assert framing.decode_envelope(framing.encode_envelope(m)) == m


def test_rejects():
    with pytest.raises(framing.FrameError):
        framing.decode_envelope(b"\xff" * 4)
    with pytest.raises(framing.FrameError):
        framing.decode_envelope(b"x" * 20, most=10)
    with pytest.raises(framing.FrameError):
        framing.FrameReader(8).feed(framing.frame(b"123456789"))
    with pytest.raises(framing.FrameError):
        framing.FrameReader().feed(b"\xff\xff\xff\xff")


def test_frames_before_a_broken_length(spark, tmp_path):
    good = [framing.frame(framing.encode_envelope({"kind": "subscribe", "topic": f"t{i}", "token": "k"})) for i in range(3)]
    reader = framing.FrameReader()
    assert len(reader.feed(b"".join(good) + b"\xff\xff\xff\xff")) == 3
    with pytest.raises(framing.FrameError):
        reader.feed(b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"".join(good) + b"\xff\xff\xff\xff")
    found = formats.read_frames(spark, f"file://{tmp_path}/in").orderBy("n").collect()
    assert [r.topic for r in found] == ["t0", "t1", "t2", None] and found[3].error == "length -1"


def test_stream_reads_late_names_once(tmp_path):
    reader = formats.FrameReaderStream({"path": str(tmp_path)})
    at = [reader.initialOffset()]
    for name in ("m.bin", "z.bin", "a.bin"):
        (tmp_path / name).write_bytes(b"")
        import os
        import time

        os.utime(tmp_path / name, ns=(time.time_ns(), time.time_ns()))
        at.append(reader.latestOffset())
    assert [[os.path.basename(p.path) for p in reader.partitions(x, y)] for x, y in zip(at, at[1:], strict=False)] == [["m.bin"], ["z.bin"], ["a.bin"]]
    assert reader.partitions(at[-1], reader.latestOffset()) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=20), st.integers(1, 17))
def test_partial_reads(payloads, step):
    raw, reader, out = b"".join(map(framing.frame, payloads)), framing.FrameReader(), []
    for i in range(0, len(raw), step):
        out += reader.feed(raw[i : i + step])
    assert out == payloads and reader.rest == b""


def test_wire_size_is_the_encoded_length(spark):
    from pyspark.sql import functions as F

    from tidewire.functions.columns import publish_size

    rows = [(t, s, bytearray(d)) for t in TEXTS for s in TEXTS[:3] for d in DATA]
    df = spark.createDataFrame(rows, "topic string, source string, data binary")
    for r in df.select("*", publish_size(F.col("topic"), F.col("source"), F.col("data")).alias("size")).collect():
        assert r["size"] == len(framing.encode_envelope({"kind": "publish_outbound", **r.asDict()}))


def test_files_and_stream(spark, tmp_path):
    ms = [{"kind": "publish_inbound", "topic": f" T{i} ", "source": "s", "token": "k", "data": b"d%d" % i} for i in range(5)]
    folder = tmp_path / "frames"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"".join(framing.frame(framing.encode_envelope(m)) for m in ms) + framing.frame(b"\xff\xff"))
    found = formats.read_frames(spark, f"file://{folder}").orderBy("n").collect()
    assert [r.topic for r in found[:5]] == [m["topic"] for m in ms] and found[5].error
    formats.register(spark)
    assert spark.read.format("frames").load(str(folder)).count() == 6
    assert sorted(r.topic for r in formats.topics_of(formats.read_frames(spark, f"file://{folder}")).collect()) == [f"t{i}" for i in range(5)]
    stream = spark.readStream.format("frames").load(str(folder))
    query = stream.writeStream.format("memory").queryName("frames_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("frames_out").count() == 6


def test_written_frames(spark, tmp_path):
    df = spark.createDataFrame([("publish_inbound", f"t{i}", "s", "k", bytearray(b"z")) for i in range(200)], "kind string, topic string, source string, token string, data binary")
    formats.write_frames(df.coalesce(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert {r.topic for r in formats.read_written(spark, str(tmp_path / "out")).collect()} == {f"t{i}" for i in range(200)}


def test_options(tmp_path):
    (tmp_path / "b.properties").write_text("max-frame=1\n")
    (tmp_path / "A.properties").write_text("# c\nmax-frame = 99\ndrop-unknown=false\n")
    found = options({"WINDOW": "8"}, tmp_path)
    assert (found.max_frame, found.drop_unknown, found.window, found.queue_capacity) == (99, False, 8, 1024)


def test_proof(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "b")], "x string, y string").select(authentication.proof_column("k", F.col("x"), F.col("y")).alias("p"))
    assert df.first().p == authentication.proof("k", "a", "b") != authentication.proof("other", "a", "b")


def test_cluster_round_trip():
    from tidewire.sources import cluster

    gossip = [{"node_id": "n1", "state": "DEAD", "incarnation": 7, "host": "h", "cluster_port": 9}, {"node_id": "n2", "state": "ALIVE", "incarnation": -1, "host": "", "cluster_port": 0}]
    samples = {
        "publish": {"topic": "t", "source": "s", "origin_node_id": "n", "origin_epoch": 1718900000000, "seq": 5, "link_seq": 300, "data": b"\xff"},
        "ack": {"acker_node_id": "a", "acks": [{"origin_node_id": "n", "origin_epoch": 1, "acked_seq": 2}]},
        "interest_sync": {"node_id": "n", "interest_version": 3, "topics": ["a", "", "é"]},
        "ping": {"seq_no": 1, "piggyback": gossip},
        "join_ack": {"members": gossip},
    }
    for kind in cluster.ARMS:
        m = {"kind": kind, **cluster.decode(kind, b""), **samples.get(kind, {})}
        assert cluster.decode_envelope(cluster.encode_envelope(m)) == m
    assert cluster.decode_envelope(b"")["kind"] == ""
    with pytest.raises(framing.FrameError):
        cluster.decode_envelope(b"\xff" * 4)
    assert len(cluster.ARMS) == 17


def test_stream_sink(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"".join(framing.frame(framing.encode_envelope({"kind": "publish_inbound", "topic": f"t{i}", "source": "s", "token": "k", "data": b"x" * i})) for i in range(150)))
    stream = spark.readStream.format("frames").load(str(tmp_path / "in")).select("kind", "topic", "source", "token", "data")
    query = stream.writeStream.format("frames").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    back = spark.read.format("frames").load(str(tmp_path / "out"))
    assert {(r.topic, len(r.data)) for r in back.collect()} == {(f"t{i}", i) for i in range(150)} and back.count() == 150


def test_two_sources_and_their_union(spark, tmp_path):
    from tidewire.sources import cluster

    (tmp_path / "links").mkdir()
    acks = [{"kind": "ack", "acker_node_id": "n1", "acks": [{"origin_node_id": "n2", "origin_epoch": 5, "acked_seq": i}]} for i in range(4)]
    raw = b"".join(framing.frame(cluster.encode_envelope(m)) for m in [*acks, {"kind": "publish", "topic": "x", "data": b"y"}])
    (tmp_path / "links" / "n1.bin").write_bytes(raw + framing.frame(b"\xff\xff") + b"\xff\xff\xff\xff")
    rows = formats.read_links(spark, f"file://{tmp_path}/links").orderBy("n").collect()
    assert [r.kind for r in rows] == ["ack"] * 4 + ["publish", None, None] and rows[5].error and rows[6].error
    assert [r.acks[0].acked_seq for r in rows[:4]] == [0, 1, 2, 3] and rows[4].data == b"y" and rows[4].acks is None
    (tmp_path / "clients").mkdir()
    (tmp_path / "clients" / "c.bin").write_bytes(framing.frame(framing.encode_envelope({"kind": "publish_inbound", "topic": "x", "data": b"z"})))
    both = formats.read_frames(spark, f"file://{tmp_path}/clients").unionByName(formats.read_links(spark, f"file://{tmp_path}/links"), allowMissingColumns=True)
    assert sorted(bytes(r.data) for r in both.where("topic = 'x'").collect()) == [b"y", b"z"]
