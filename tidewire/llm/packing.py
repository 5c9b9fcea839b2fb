"""Best-fit packing of documents into sequences by swap-based local search.

Documents are tokenised where they lie and cut into pieces; only (document, piece, length, checksum) is shuffled. Full
pieces are sequences of their own. The others are packed in blocks of bounded size: best-fit decreasing first, then a
local search that moves one piece, or exchanges one for one or two for one, between underfull bins whenever that
raises the sum of squared fills, until bins empty or nothing improves. What a block leaves in underfull bins goes to
the next round, where blocks are dealt anew from all leftovers, so the loss doesn't grow with the number of blocks.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, chunked, staged

LENGTH, END_ID = 2048, 0
#: Pieces that one task packs at once, and rounds of dealing leftovers anew.
BLOCK, ROUNDS = 8192, 3
#: The local search's effort: turns of a bin, acts of a turn, and places looked at for what it gives away.
TURNS, ACTS, REACH = 24, 16, 64
#: Texts with other characters than these, or with longer unbroken runs, go through `tokenizers` itself.
PLAIN = r"^[\x{0000}-\x{052F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]*$"
LONG_RUN = r"\S{1000}"

_tokenizers: dict[str, ByteTokenizer] = {}


class ByteTokenizer:
    """Ids of a byte-level BPE file of `tokenizers`, as that library gives them without adding special tokens.

    `tiktoken` applies the same vocabulary, read from the same file, with the same split pattern about four times as
    fast, and gives the same ids where both libraries' character classes agree; the tests compare them. Other texts,
    very long unbroken runs, and texts that hold the string of a special token (which has an id of its own) are left to
    `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.inner = Tokenizer.from_file(path)
        self.inner.no_padding()
        self.inner.no_truncation()
        # the printable characters that stand for the bytes: those that print stand for themselves, others follow at 256
        printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stands_for = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printing)}
        assert set(stands_for) == set(ByteLevel.alphabet())
        special = {x.content for x in self.inner.get_added_tokens_decoder().values()}
        ranks = {bytes(stands_for[c] for c in token): i for token, i in self.inner.get_vocab().items() if token not in special}
        self.special = "|".join(map(re.escape, sorted(special)))
        self.quick = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        plain = pc.and_not(pc.match_substring_regex(texts, PLAIN), pc.match_substring_regex(texts, LONG_RUN))
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(texts, self.special))
        out = []
        for quick, text in zip(plain.to_pylist(), texts, strict=True):
            text = text.as_py()
            out.append(self.quick.encode_to_numpy(text) if quick else np.array(self.inner.encode(text, add_special_tokens=False).ids, np.uint32))
        return out


def tokenizer_at(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    head = total % length or min(total, length)
    return [(0, head), *((a, length) for a in range(head, total, length))]


def pieces(docs: DataFrame, tokenizer_path: str, *, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: uid (of the row), doc_id, piece, start, length, ids_crc32, and the ids if wanted."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            row, piece, start, size, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(tokenizer_at(tokenizer_path).encode(batch.column(2))):
                own = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (a, m) in enumerate(cut(len(own), length)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(m)
                    crc.append(zlib.crc32(own[a : a + m]))
                    if with_ids:
                        kept.append(own[a : a + m].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of indices."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]  # bins that have just this room
    rooms: list[int] = []  # the rooms for which there are bins, ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Places:
    """Where a piece could go: (free places once a piece of `size` left the bin, size, piece or -1, bin, the bin's state), sorted."""

    def __init__(self, bins: dict[int, list[int]], size: list[int], length: int) -> None:
        self.bins, self.size, self.length, self.state = bins, size, length, dict.fromkeys(bins, 0)
        self.stale = 0
        self.places = sorted(x for b in bins for x in self._of(b))

    def _of(self, b: int) -> list[tuple[int, int, int, int, int]]:
        room = self.length - sum(self.size[i] for i in self.bins[b])
        return [(room, 0, -1, b, self.state[b]), *((room + self.size[i], self.size[i], i, b, self.state[b]) for i in self.bins[b])] if room else []

    def changed(self, b: int) -> None:
        self.state[b] += 1
        self.stale += len(self.bins[b]) + 1
        if 2 * self.stale > len(self.places):
            self.places, self.stale = sorted(x for c in self.bins for x in self._of(c)), 0
        else:
            for x in self._of(b):
                bisect.insort(self.places, x)

    def best(self, n: int, own: int) -> tuple[int, int, int, int] | None:
        """(room that stays, size of the piece that is given back, piece or -1, bin) of the tightest of the next REACH places for n, from which a smaller piece or none comes back."""
        first = bisect.bisect_left(self.places, (n,))
        for at in range(first, min(first + REACH, len(self.places))):
            room, m, i, b, state = self.places[at]
            if m < n and b != own and self.state.get(b) == state:
                return room - n, m, i, b
        return None


def improve(bins: list[list[int]], sizes: np.ndarray, length: int) -> list[list[int]]:
    """Local search over the underfull bins: raise the sum of squared fills by moves and exchanges until nothing helps.

    The emptiest bin gives up what it can: a piece is moved into a fuller bin, or one or two pieces are exchanged for a
    smaller one there, wherever the fuller bin gets fullest; an index of all places by what fits there finds it. An
    empty bin is gone. A bin that can't give anything away waits until another has. The search ends when no bin can, at
    the fewest bins that the sizes allow, or when each bin has had its TURNS, each of ACTS at most; that and REACH bound
    the effort only: every piece stays packed, some bins may stay that a longer search would empty.
    """
    size = sizes.tolist()
    fewest = -(-sum(size) // length)
    fill = [sum(size[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill, strict=True) if f == length]
    work = {k: list(b) for k, (b, f) in enumerate(zip(bins, fill, strict=True)) if f < length}
    filled = {k: fill[k] for k in work}
    turns, places, waiting = dict.fromkeys(work, TURNS), _Places(work, size, length), set()
    queue = [(f, k) for k, f in filled.items()]
    heapq.heapify(queue)
    while queue and len(work) > 1 and len(done) + len(work) > fewest:
        f, low = heapq.heappop(queue)
        if low in waiting or filled.get(low) != f or not turns[low]:
            continue
        turns[low] -= 1
        gave = False
        for _ in range(ACTS):
            if low not in work:
                break
            own, best = work[low], None
            for give in [*((i,) for i in own), *((i, j) for x, i in enumerate(own) for j in own[x + 1 :])]:
                n = sum(size[i] for i in give)
                if n <= length and (found := places.best(n, low)) and (len(give) == 1 or found[2] >= 0):
                    room, m, i, b = found
                    # the sum of squares rises if the other bin gets more than it has over this one
                    if n - m > f - filled[b] and (best is None or (room, m - n) < best[:2]):
                        best = (room, m - n, give, i, b)
            if best is None:
                break
            room, gain, give, back, b = best
            gave = True
            work[low] = [i for i in own if i not in give] + [back] * (back >= 0)
            work[b] = [i for i in work[b] if i != back] + list(give)
            f += gain
            filled[low], filled[b] = f, length - room
            if not room:
                done.append(work.pop(b))
                del filled[b], places.state[b]
                places.stale += len(done[-1]) + 1
            else:
                places.changed(b)
                heapq.heappush(queue, (filled[b], b))
            if work[low]:
                places.changed(low)
            else:
                del work[low], filled[low], places.state[low]
        if gave:
            for k in waiting & work.keys():
                heapq.heappush(queue, (filled[k], k))
            waiting.clear()
        if low in work and turns[low]:
            waiting.add(low)
    return done + list(work.values())


def pack_block(sizes: np.ndarray, length: int) -> list[list[int]]:
    return improve(best_fit(sizes, length), sizes, length)


def _pack(length: int, block: int, last: bool):
    """Arrow rows of one partition, in blocks; bins that are full enough, in the last round all, are closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, block):
            sizes = np.asarray(table.column("length"), np.int64)
            order, sequence, offset = [], [], []
            uid = np.asarray(table.column("uid"), np.int64)
            for b in pack_block(sizes, length):
                closed = last or int(sizes[b].sum()) >= length - length // 256
                at = 0
                for i in b:
                    order.append(i)
                    sequence.append(int(uid[b[0]]) if closed else None)
                    offset.append(at)
                    at += int(sizes[i])
            out = table.take(pa.array(order, pa.int64())).drop_columns(["sequence_id", "offset"])
            out = out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from out.to_batches()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, block - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == block:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def pack_pieces(cut_up: DataFrame, *, length: int = LENGTH, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to pieces (uid, piece, length, ...). Of a document at most the first piece is short.

    A full piece is a sequence of its own, with a negative number. A bin has the uid of its first piece as its number.
    Before the last round bins that lack more than length / 256 give their pieces back.
    """
    full = cut_up.where(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    names = full.columns
    short = cut_up.where(F.col("length") < length).withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    schema, done, left = short.schema, full, short
    for k in range(rounds):
        last = k == rounds - 1
        tasks = max(1, -(-left.count() // block))
        # equal shares of every length in each block: dealt by a hash of the row
        dealt = left.repartition(tasks, F.xxhash64(F.lit(k), "uid"))
        packed = staged(dealt.select(*names).mapInArrow(_pack(length, 2 * block, last or tasks == 1), schema), f"packed-{k}")
        done = done.unionByName(packed.where(F.col("sequence_id").isNotNull()))
        if last or tasks == 1:
            break
        left = packed.where(F.col("sequence_id").isNull())
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, *, length: int = LENGTH, block: int = BLOCK, rounds: int = ROUNDS, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the end id alone. Repeated rows are documents of their own with the same doc_id. Longer
    documents than a sequence are cut into full pieces, the first may be shorter; no other is cut. An empty table gives
    no rows; other columns are never read. A text of any length is tokenised whole.
    """
    bounded_batches(docs.sparkSession)
    cut_up = staged(pieces(docs, tokenizer_path, length=length, with_ids=with_ids), "pieces")
    return pack_pieces(cut_up, length=length, block=block, rounds=rounds).drop("uid")
