"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of LEAST bytes that covers it also starts in a document with a smaller doc_id.

Candidates. Every LEAST-byte window takes the least hash of the GRAM-byte strings in it as its key; equal windows have
equal keys. Neighbouring windows with one key form a run. Chunks of documents send their distinct keys (a few bytes per
16 bytes of text) to the key's bucket and get one bit per key back: if another document has it. Only runs with such
keys go on, each as the text that its windows cover, once per chunk however often it occurs there.

Matches. Runs of one key meet in one task. A text that has its key alone there, as inner parts of copied passages do,
shares no window with another. The suffixes of the others are sorted by prefix doubling, the transform is read off, and
common prefixes are derived breadth-first by increasing value: an interval boundary of value v gives, extended backward
by each preceding byte, boundaries of value v + 1. Expansion stops at LEAST: suffixes that no boundary separates share
LEAST bytes. The least doc_id of each such group goes back to the chunks, which remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import NO_ID, chunk_table, groups, opened, rows_of
from tidewire.llm.common import bounded_batches, mix64, plan_bytes, ragged, staged, whole_ids
from tidewire.llm.textarrays import BASE, powers

LEAST, GRAM = 50, 20
#: Bytes of run texts in a task of matching, of text per bucket of keys; longest run in windows.
MATCHED, BUCKET, LONGEST_RUN = 3 << 19, 64 << 20, 256
KEY_BITS = 39
NONE = NO_ID


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, first window, number of windows) of each run; windows are named by their first byte."""
    n = len(raw)
    last = offsets[1:] - LEAST  # last window of each document
    if n < LEAST:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    # eight bytes at a time, the last eight where the gram ends
    m, g = n - GRAM + 1, np.zeros(n - GRAM + 1, np.uint64)
    for at in [*range(0, GRAM - 8, 8), GRAM - 8]:
        g += x[at : at + m]
        g *= BASE
        g ^= g >> np.uint64(32)
    g *= np.uint64(0x165667B19E3779F9)
    g ^= g >> np.uint64(29)
    width = LEAST - GRAM + 1
    size = 1
    while 2 * size <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    if size < width:
        g = np.minimum(g[: len(g) - (width - size)], g[width - size :])
    docs = np.flatnonzero(last >= offsets[:-1])
    new = np.zeros(len(g) + 1, bool)
    new[1:-1] = g[1:] != g[:-1]
    valid = np.zeros(len(g) + 1, np.int64)
    np.add.at(valid, offsets[:-1][docs], 1)
    np.add.at(valid, last[docs] + 1, -1)
    new[offsets[:-1][docs]] = True
    inside = np.cumsum(valid[:-1]) > 0
    start = np.flatnonzero(new[:-1] & inside)
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], n), last[doc] + 1)
    count = end - start
    parts = -(-count // LONGEST_RUN)
    row, place = ragged(parts)
    start = start[row] + place * LONGEST_RUN
    # least hashes crowd near 0; keys are dealt by their leading bits, so they are scattered once more
    return mix64(g[start]), doc[row], start, np.minimum(count[row] - place * LONGEST_RUN, LONGEST_RUN)


def chunk_keys(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sorted; if several documents of the chunk have it; for each run the place of its key); doc ascends."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], doc[order[first]] != doc[order[last]], place


def _bounds(distinct: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(distinct, edges), len(distinct))


def _send_keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, offsets, raw = opened(row)
            key, doc, _, _ = runs(raw, offsets)
            if not len(key):
                continue
            distinct, several, _ = chunk_keys(key, doc)
            entry = ((distinct >> np.uint64(64 - bits - KEY_BITS)) & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(1) | several.astype(np.uint64)
            short = np.ascontiguousarray(entry.view(np.uint8).reshape(-1, 8)[:, :5])
            bound = _bounds(distinct, bits)
            some = np.flatnonzero(np.diff(bound))
            blobs = [short[bound[b] : bound[b + 1]].tobytes() for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row["chunk_id"]] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk_id", "keys"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket and chunk one bit for each key that the chunk sent: if another document has it."""
    for t in groups(batches, "bucket"):
        blobs = t["keys"].to_pylist()
        sizes = np.array([len(b) // 5 for b in blobs])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        entry = wide.view(np.uint64).ravel()
        order = np.argsort(entry >> np.uint64(1))
        key, several = (entry >> np.uint64(1))[order], (entry & np.uint64(1))[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        good = (np.diff(np.append(first, len(key))) > 1) | (np.maximum.reduceat(several, first) > 0)
        shared = np.empty(len(entry), bool)
        shared[order] = np.repeat(good, np.diff(np.append(first, len(key))))
        packed = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([t["chunk_id"].combine_chunks(), t["bucket"].combine_chunks(), pa.array(packed, pa.binary()), pa.array([int(x.sum()) for x in np.split(shared, np.cumsum(sizes)[:-1])], pa.int64())], ["chunk_id", "bucket", "bits", "n"])


def _send_runs(bits: int):
    """Texts of the runs with shared keys, each once per chunk: chunk_id, key, text, doc_id (least), places (u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            docs, offsets, raw = opened(row)
            key, doc, start, count = runs(raw, offsets)
            distinct, _, place = chunk_keys(key, doc)
            bound, shared = _bounds(distinct, bits), np.zeros(len(distinct), bool)
            for x in row["marks"]:
                a, b = bound[x["bucket"]], bound[x["bucket"] + 1]
                shared[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
            use = np.flatnonzero(shared[place])
            if not len(use):
                continue
            key, doc, start, count = key[use], doc[use], start[use], count[use]
            for at in range(0, len(use), 20_000):
                part = slice(at, at + 20_000)
                yield _run_rows(row["chunk_id"], raw, docs, key[part], doc[part], start[part], count[part])

    return run


def _run_rows(chunk_id: int, raw: np.ndarray, docs: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    size = count + LEAST - 1
    row, within = ragged(size)
    text = raw[start[row] + within]
    first = np.cumsum(size) - size
    name = np.add.reduceat(mix64(text.astype(np.uint64) + np.uint64(257)) * powers(int(size.max()))[within], first)
    name = mix64(name + size.astype(np.uint64)) ^ key
    # equal names, checked byte by byte against the first of them; unequal texts stay apart
    order = np.lexsort((docs[doc], name))
    head = np.append(True, name[order][1:] != name[order][:-1])
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    same = (size == size[leader])[row]
    same[same] = text[same] == text[(first[leader][row] + within)[same]]
    leader = np.where(np.minimum.reduceat(same, first), leader, np.arange(len(order)))
    keep, group = np.unique(leader, return_inverse=True)
    by = np.argsort(group, kind="stable")
    per = np.bincount(group)
    least = np.minimum.reduceat(docs[doc][by], np.cumsum(per) - per)
    places = start[by].astype("<u4").tobytes()
    offs = np.append(0, 4 * np.cumsum(per)).astype(np.int32)
    kept_rows = np.zeros(len(order), bool)
    kept_rows[keep] = True
    text_offs = np.append(0, np.cumsum(size[keep])).astype(np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(text_offs), pa.py_buffer(np.ascontiguousarray(text[kept_rows[row]]))])
    where = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offs), pa.py_buffer(places)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), chunk_id), pa.int64()), pa.array(key[keep].view(np.int64)), texts, pa.array(least, pa.int64()), where], ["chunk_id", "key", "text", "doc_id", "places"])


def _sorted_suffixes(symbols: np.ndarray, least: int) -> np.ndarray:
    """Suffixes in the order of at least their first least + 1 symbols, by prefix doubling from four.

    Up to 2**21 suffixes, two ranks and the suffix itself fit one 64-bit value, and plain values sort several times
    faster than they are ranked by argsort.
    """
    n = len(symbols)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = symbols
    value, depth = np.zeros(n, np.uint64), 4
    for i in range(4):
        value = value << np.uint64(9) | padded[i : i + n]
    low, packed = np.uint64(21), n < 1 << 21
    index = np.arange(n, dtype=np.uint64)
    while True:
        if packed:
            ordered = value << low | index
            ordered.sort()
            suffix = (ordered & np.uint64((1 << 21) - 1)).astype(np.int32)
            ordered >>= low
        else:
            suffix = np.argsort(value)
            ordered = value[suffix]
        if depth > least:
            return suffix
        rank = np.empty(n, np.uint64)
        rank[suffix] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        after[: max(n - depth, 0)] = rank[depth:]
        value, depth = rank << (low if packed else np.uint64(32)) | after, 2 * depth


def common_prefix_groups(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array up to ties, group of each of its places): suffixes are in one group if they share `least` symbols.

    symbols: one string over 0 to 256 that ends with 0 and has no two 0 in a row. Only prefixes up to the doubling depth (at least `least` + 1) are ordered; inside
    a group the order doesn't matter, as an interval of the transform maps onto an interval whatever its inner order.
    """
    suffix = _sorted_suffixes(symbols, least)
    n = len(symbols)
    transform = np.where(suffix > 0, symbols[suffix - 1].astype(np.uint16), np.uint16(257))
    occurrence = np.argsort(transform, kind="stable").astype(np.int32)  # the i-th of them, by symbol and then by place, maps onto place i
    symbol = transform[occurrence]
    opens = np.append(True, symbol[1:] != symbol[:-1])
    # The symbols before the suffixes lack the last symbol, 0, which precedes none, and hold 257 for the first suffix.
    # As 0 sorts first and 257 last, occurrence i maps onto place i + 1 of the suffix array.
    source = np.flatnonzero(~opens & (symbol != 257)).astype(np.int32)
    place, before, target = occurrence[source], occurrence[source - 1], source + 1
    bounded = np.zeros(n, bool)
    fresh = np.append(True, symbols[suffix][1:] != symbols[suffix][:-1])  # boundaries of value 0
    for value in range(least):
        if value == 1 and n > 1 and symbols[suffix[1]] == 0:
            fresh[1] = True  # between the last suffix and the next that starts with 0
        bounded |= fresh
        if not len(target) or not fresh.any():
            break
        seen = np.cumsum(fresh, dtype=np.int32)
        hit = seen[place] > seen[before]
        fresh = np.zeros(n, bool)
        fresh[target[hit]] = True
        left = ~hit
        place, before, target = place[left], before[left], target[left]
    return suffix, np.cumsum(bounded) - 1


def least_windows(texts: list[bytes], docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text, one text after the other, the least document that holds it; and the texts' numbers of windows."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    joined[starts + sizes] = 0
    owner, within = ragged(sizes + 1)
    suffix, group = common_prefix_groups(joined, least)
    window = within + least <= sizes[owner]
    value = np.where(window, docs[owner], NONE)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low = np.empty(len(joined), np.int64)
    low[suffix] = np.minimum.reduceat(value[suffix], first)[group]
    return low[window], np.maximum(sizes - least + 1, 0)


def least_documents(texts: list[bytes], docs: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """least_windows as one array per text."""
    low, counts = least_windows(texts, docs, least)
    return np.split(low, np.cumsum(counts)[:-1])


def found_runs(texts: pa.Array, low: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least documents of the windows of distinct texts, run-length coded: (lengths, documents, each text's number of runs, its first run).

    low: the least document that holds the whole text; tag: a value that depends on the text's key only. Equal windows
    have equal keys, so a text that has its tag alone shares no window with another, and its windows are in the documents
    that hold all of it. Only texts that share a tag are expanded.
    """
    number = np.unique(tag, return_inverse=True)[1]
    several = np.bincount(number)[number] > 1
    alone, met = np.flatnonzero(~several), np.flatnonzero(several)
    lengths, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_runs, first_run = np.ones(len(tag), np.int64), np.zeros(len(tag), np.int64)
    if len(met):
        found, counts = least_windows(texts.take(pa.array(met, pa.int64())).to_pylist(), low[met])
        # maximal stretches of one document in each text
        begins = np.cumsum(counts) - counts
        new = np.append(True, found[1:] != found[:-1])
        new[begins] = True
        cut = np.flatnonzero(new)
        lengths, values = np.diff(np.append(cut, len(found))), found[cut]
        n_runs[met] = np.bincount(np.searchsorted(begins, cut, side="right") - 1, minlength=len(counts))
        first_run[met] = np.cumsum(n_runs[met]) - n_runs[met]
    first_run[alone] = len(lengths) + np.arange(len(alone))
    windows = np.asarray(pa.compute.binary_length(texts), np.int64)[alone] - LEAST + 1
    return np.append(lengths, windows), np.append(values, low[alone]), n_runs, first_run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and chunk one row of findings: for each run text its places and the least documents of its windows, run-length coded."""
    for t in groups(batches, "task"):
        t = t.combine_chunks()
        coded = t["text"].combine_chunks().dictionary_encode()
        which, docs = np.asarray(coded.indices, np.int64), np.asarray(t["doc_id"], np.int64)
        low, tag = np.full(len(coded.dictionary), NONE), np.empty(len(coded.dictionary), np.int64)
        np.minimum.at(low, which, docs)
        tag[which] = np.asarray(t["tag"], np.int64)
        lengths, values, n_runs, first_run = found_runs(coded.dictionary, low, tag)
        n_places = np.asarray(pa.compute.binary_length(t["places"].combine_chunks()), np.int64) // 4
        # a text that one document of the chunk holds, and that is its own throughout, needs no answer
        use = np.flatnonzero((n_places > 1) | (n_runs[which] > 1) | (values[first_run[which]] != docs))
        places = dict(zip(use.tolist(), t["places"].combine_chunks().take(pa.array(use, pa.int64())).to_pylist(), strict=True))
        chunk = np.asarray(t["chunk_id"], np.int64)[use]
        order = np.argsort(chunk, kind="stable")
        use, chunk = use[order], chunk[order]
        ids, blobs = [], []
        for rows in np.split(use, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1) if len(use) else []:
            runs_of = n_runs[which[rows]]
            item, k = ragged(runs_of)
            run = first_run[which[rows]][item] + k
            head = np.array([len(rows), n_places[rows].sum(), len(run)], "<u4")
            parts = [head, n_places[rows].astype("<u4"), runs_of.astype("<u4")]
            tail = [lengths[run].astype("<u4"), values[run].astype("<i8")]
            blobs.append(b"".join([*[p.tobytes() for p in parts], *[places[i] for i in rows], *[p.tobytes() for p in tail]]))
            ids.append(int(np.asarray(t["chunk_id"][int(rows[0])].as_py())))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["chunk_id", "found"])


def _removed(docs: np.ndarray, offsets: np.ndarray, found: list[bytes], n: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    change = np.zeros(n + 1, np.int64)
    for blob in found:
        items, all_places, all_runs = np.frombuffer(blob, "<u4", 3).astype(int)
        at = 12
        n_places, n_runs = (np.frombuffer(blob, "<u4", items, x).astype(np.int64) for x in (at, at + 4 * items))
        at += 8 * items
        places = np.frombuffer(blob, "<u4", all_places, at).astype(np.int64)
        lengths = np.frombuffer(blob, "<u4", all_runs, at + 4 * all_places).astype(np.int64)
        values = np.frombuffer(blob, "<i8", all_runs, at + 4 * (all_places + all_runs))
        # every place of an item with every run of it
        total = np.cumsum(lengths) - lengths
        first_run = np.cumsum(n_runs) - n_runs
        begin = total - total[np.repeat(first_run, n_runs)] if all_runs else total
        item = np.repeat(np.arange(items), n_places)
        place, k = ragged(n_runs[item])
        run = first_run[item][place] + k
        where = places[place]
        own = docs[np.searchsorted(offsets, where, side="right") - 1]
        hit = values[run] < own
        np.add.at(change, where[hit] + begin[run[hit]], 1)
        np.add.at(change, where[hit] + begin[run[hit]] + lengths[run[hit]] + LEAST - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            docs, offsets, raw = opened(row)
            gone = _removed(docs, offsets, row["found"] or [], len(raw))
            nulls = np.frombuffer(row["nulls"], np.int8).astype(bool)
            sums = np.append(0, np.cumsum(gone))
            opens = gone & ~np.append(False, gone[:-1])
            opens[offsets[:-1][offsets[:-1] < len(raw)]] |= gone[offsets[:-1][offsets[:-1] < len(raw)]]
            spans = np.append(0, np.cumsum(opens))
            digests, texts = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                kept = (raw[a:b] if sums[b] == sums[a] else raw[a:b][~gone[a:b]]).tobytes()
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
            columns = [pa.array(docs, mask=nulls), pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets])), pa.array(np.diff(spans[offsets])), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes that are kept).

    Null texts are empty; a null doc_id is above all others, so strings of such rows make nothing go in other rows but
    in none of each other's; rows with one doc_id leave each other alone. Texts may end inside a character after
    removal, so kept text is binary. A text longer than a chunk is a chunk of its own, with some twenty bytes of memory
    for each of its. Ids that aren't whole numbers are refused. An empty table gives no rows; other columns are never read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = whole_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(False).alias("flag"))
    chunks = chunk_table(rows, plan_bytes(docs))
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, (max(parts, -(-total // BUCKET)) - 1).bit_length())
    keys = chunks.select("chunk_id", "docs", "offsets", "raw").mapInArrow(_send_keys(bits), "bucket long, chunk_id long, keys binary")
    marks = keys.repartitionById(1 << bits, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_shared, "chunk_id long, bucket long, bits binary, n long")
    marks = staged(marks, "marks")
    shared = marks.agg(F.sum("n")).first()[0] or 0
    marks = marks.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    marked = chunks.join(marks.hint("shuffle_hash"), "chunk_id").select("chunk_id", "docs", "offsets", "raw", "marks")
    sent = marked.mapInArrow(_send_runs(bits), "chunk_id long, key long, text binary, doc_id long, places binary")
    # a run has about (width + 1) / 2 windows, so its text has about 65 bytes
    tasks = max(1, -(-shared * (LEAST + (LEAST - GRAM) // 2) // MATCHED))
    dealt = sent.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).withColumn("tag", F.col("key").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    found = dealt.repartition(max(parts, tasks), "task").sortWithinPartitions("task").select("task", "chunk_id", "tag", "text", "doc_id", "places").mapInArrow(_match, "chunk_id long, found binary")
    found = staged(found, "found").groupBy("chunk_id").agg(F.collect_list("found").alias("found"))
    joined = chunks.join(found.hint("shuffle_hash"), "chunk_id", "left").select("docs", "nulls", "offsets", "raw", "found")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(_cut(with_text), schema)
