"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share one vocabulary: every word of the corpus.
They are matched: both are smoothed alike, the background's counts are weighed so that both models rest on equally many
tokens (as a sample of the target's size would on average, but every document counts), and no document is scored with
counts of its own. A document's score is its loss per token under the target model less that under the background model
(low: like the target).

Word and bigram counts cover all documents. Both grow with the corpus and are never gathered in one place: each chunk of
documents sends its distinct words and bigrams as keys, with its own counts, to their buckets; a bucket sums them up and
answers each chunk with what other chunks have of just the keys that it sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import chunk_table, groups, opened, rows_of
from tidewire.llm.common import bounded_batches, mix64, plan_bytes, staged, whole_ids
from tidewire.llm.textarrays import BASE, words_of

#: Weight of the unigram in the bigram's estimate.
WEIGHT = 50.0
#: The edge of a text, as a word's hash; bytes of text for a chunk and for a bucket of keys.
EDGE, CHUNK, BUCKET = np.uint64(0xC2B2AE3D27D4EB4F), 4 << 20, 16 << 20
#: Bits of a key's hash that are sent, beside those that name its bucket, and a bit that tells words from bigrams. As a
#: bucket has one size, one key in some 100,000 shares its counts with another at any size of the corpus.
SENT_BITS = 39
MOST_BROADCAST = 1_000_000


def keys_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key of the word before, key of the word, key of both) of each token, the end of a text being one. Keys of words are odd, others even."""
    w = words_of(raw, offsets)
    some = np.flatnonzero(w.counts)
    first = (np.cumsum(w.counts) - w.counts)[some]
    before = np.insert(w.hash, first, EDGE) | np.uint64(1)  # each text starts with the edge ...
    after = np.insert(w.hash, first + w.counts[some], EDGE) | np.uint64(1)  # ... and ends with it
    return np.repeat(some, w.counts[some] + 1), before, after, mix64(before * BASE + after) & ~np.uint64(1)


def _edges(code: np.ndarray, bits: int) -> np.ndarray:
    """Edges of the 2**bits buckets in sorted keys; the highest bits name a key's bucket."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(code, starts), len(code))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of integers, those of equal weight together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _sent(code: np.ndarray, n: np.ndarray, t: np.ndarray, bits: int) -> bytes:
    """Keys of one bucket as differences, and their counts."""
    short = (code >> np.uint64(64 - bits - SENT_BITS) & np.uint64((1 << SENT_BITS) - 1)) << np.uint64(1) | code & np.uint64(1)
    return pa.compress(len(code).to_bytes(4, "little") + _planes(np.diff(short, prepend=np.uint64(0)), 5) + _counts(n) + _counts(t), codec="zstd", asbytes=True)


def _received(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(5, n).T
    code = np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) & np.uint64((1 << 40) - 1)
    first, at = _uncounted(raw, 4 + 5 * n, n)
    return code, first, _uncounted(raw, at, n)[0]


def _counts(x: np.ndarray) -> bytes:
    """Counts in a byte each; those that need more follow in eight."""
    big = x >= 255
    return np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<i8").tobytes()


def _uncounted(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n counts from place `at` on, and where they end."""
    x = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(x == 255)
    x[big] = np.frombuffer(raw, "<i8", len(big), at + n)
    return x, at + n + 8 * len(big)


def _send(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, offsets, raw = opened(row)
            doc, _, after, both = keys_of(raw, offsets)
            if not len(doc):
                continue
            code, place = np.unique(np.concatenate([after, both]), return_inverse=True)
            n = np.bincount(place, minlength=len(code))
            t = np.bincount(place, weights=np.tile(np.frombuffer(row["flags"], np.int8)[doc], 2), minlength=len(code)).astype(np.int64)
            edges = _edges(code, bits)
            some = np.flatnonzero(np.diff(edges))
            parts = [slice(edges[b], edges[b + 1]) for b in some]
            blobs = [_sent(code[x], n[x], t[x], bits) for x in parts]
            sizes = [4 + 7 * (x.stop - x.start) + 8 * int((n[x] >= 255).sum() + (t[x] >= 255).sum()) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk_id"]] * len(some), pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk_id", "size", "keys"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What other chunks have of each bucket's keys, for each chunk in the order in which it sent them; and a row without chunk: distinct words, and their counts."""
    names = ["chunk_id", "bucket", "size", "others", "words", "words_n", "words_t"]
    for table in groups(batches, "bucket"):
        got = [_received(*x) for x in zip(table["keys"].to_pylist(), table["size"].to_pylist(), strict=True)]
        distinct, place = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        own = [np.concatenate([x[i] for x in got]) for i in (1, 2)]
        total = [np.bincount(place, weights=x, minlength=len(distinct)).astype(np.int64) for x in own]
        rest = [a[place] - b for a, b in zip(total, own, strict=True)]
        edges = np.cumsum([0, *(len(x[0]) for x in got)])
        blobs = [b"".join(_counts(x[a:b]) for x in rest) for a, b in zip(edges, edges[1:], strict=False)]
        sizes = pa.array([len(x) for x in blobs], pa.int64())
        packed = pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in blobs], pa.binary())
        yield pa.RecordBatch.from_arrays([table["chunk_id"].combine_chunks(), table["bucket"].combine_chunks(), sizes, packed, *[pa.nulls(len(got), pa.int64())] * 3], names)
        word = (distinct & np.uint64(1)).astype(bool)
        sums = [int(word.sum()), *(int(x[word].sum()) for x in total)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *[pa.array([x], pa.int64()) for x in sums]], names)


def _score(total: tuple[int, int], size: int, bits: int):
    """total: tokens of the background and of the target; size: words for which smoothing leaves room."""
    share = (total[1] / total[0] if total[1] else 1.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            docs, offsets, raw = opened(row)
            doc, before, after, both = keys_of(raw, offsets)
            flag = np.frombuffer(row["flags"], np.int8)[doc]
            code, place = np.unique(np.concatenate([after, both]), return_inverse=True)
            edges = _edges(code, bits)
            counts = np.stack([np.bincount(place, minlength=len(code)), np.bincount(place, weights=np.tile(flag, 2), minlength=len(code)).astype(np.int64)])
            for x in row["others"] or []:
                a, b = edges[x["bucket"]], edges[x["bucket"] + 1]
                blob, at = pa.decompress(x["others"], decompressed_size=x["size"], codec="zstd", asbytes=True), 0
                for i in (0, 1):
                    rest, at = _uncounted(blob, at, b - a)
                    counts[i, a:b] += rest
            n = len(doc)
            word, pair = place[:n], place[n:]
            head = np.append(0, word)[:n]  # the word before, but at the start of a text the edge, which ends each text
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if n else np.zeros(0, np.int64)
            head[starts] = word[-1] if n else 0
            tokens = np.bincount(doc, minlength=len(docs))
            # each document's own counts of the keys: of the word and the pair of each token, and of the word before
            own_key, own_place, own_n = np.unique(np.tile(doc, 2) * len(code) + place, return_inverse=True, return_counts=True)
            own_word, own_pair = own_n[own_place[:n]], own_n[own_place[n:]]
            own_head = np.append(0, own_word)[:n]
            own_head[starts] = 1
            means = []
            for i in (0, 1):
                own = np.ones(n, np.int64) if i == 0 else flag
                alone = (share[i] * (counts[i, word] - own * own_word) + 1) / (share[i] * (total[i] - own * tokens[doc]) + size)
                losses = -np.log((share[i] * (counts[i, pair] - own * own_pair) + WEIGHT * alone) / (share[i] * (counts[i, head] - own * own_head) + WEIGHT))
                means.append(np.bincount(doc, weights=losses, minlength=len(docs)) / np.maximum(tokens, 1))
            background, target = means
            nulls = np.frombuffer(row["nulls"], np.int8).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=nulls), pa.array(tokens.astype(np.int64)), pa.array(target), pa.array(background), pa.array(target - background)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens (words and the end), target_loss, background_loss (mean over tokens, in nats), score.

    targets: rows with the doc_id of each target document. Null, empty and wordless texts have no tokens and losses and
    score of 0. A null doc_id is never a target; repeated rows are documents that count each, and each without its own
    counts only. With no targets at all the target model is uniform over the vocabulary and the background isn't
    weighed. A text of any length is scored whole, in one chunk. An empty table gives no rows; other columns are never
    read; ids that aren't whole numbers are refused.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = whole_ids(targets).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("t_id")).distinct()
    if (chosen := staged(chosen, "targets")).count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    rows = whole_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(chosen, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.col("t_id").isNotNull().alias("flag"))
    chunks = chunk_table(rows, plan_bytes(docs), CHUNK)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, (-(-size // BUCKET) - 1).bit_length())
    sent = chunks.select("chunk_id", "flags", "docs", "offsets", "raw").mapInArrow(_send(bits), "bucket int, chunk_id long, size long, keys binary")
    answers = sent.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_answer, "chunk_id long, bucket int, size long, others binary, words long, words_n long, words_t long")
    answers = staged(answers, "totals")
    # only these three sums come to the driver; the edge is one of the words
    words, *total = (x or 0 for x in answers.where(F.col("chunk_id").isNull()).agg(F.sum("words"), F.sum("words_n"), F.sum("words_t")).first())
    others = answers.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "size", "others")).alias("others"))
    joined = chunks.join(others.hint("shuffle_hash"), "chunk_id", "left").select("docs", "nulls", "flags", "offsets", "raw", "others")
    return joined.mapInArrow(_score(tuple(total), words + 1, bits), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
