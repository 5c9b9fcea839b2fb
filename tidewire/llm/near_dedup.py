"""Near-duplicate detection by a chosen-path set similarity join.

Each text's set of 5-word shingles gets a signature of minwise tokens. Equal sets become one class at once, so copies
are never compared. In each of several independent trees, documents branch by the minwise tokens at chosen coordinates
(one or two per node, 1/threshold on average): documents that agree there meet in a child node. A node of at most
SMALL documents is compared exhaustively. A larger node is compared in random blocks of that size first. If all its
documents are in one component by then, it has nothing left to find. If few are outside of its largest component, or
that makes a bounded number of pairs, these are compared with all of it. Otherwise all of its documents branch again;
nodes that are still large and mixed after DEEP levels are compared whole. Signatures only propose: every link is confirmed on the full sets. Units compare by
sketches, one byte for each token of the signature; the tokens themselves are only read to branch.

No pairs are listed within a group: a comparison unit gives a spanning forest of its confirmed links. Links become
components by alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, chunked, mix64, ragged, staged, text_buffers
from tidewire.llm.textarrays import BASE, distinct_per_doc, windows, words_of

SHINGLE, PERCENT = 5, 75
#: Coordinates of a signature, trees, documents of a node that is compared exhaustively, and agreeing coordinates that
#: propose a pair: 33 of 64 is over four standard deviations below what a similarity of 0.75 gives.
COORDINATES, TREES, SMALL, AGREE = 64, 8, 1024, 33
#: Shingles that a task of confirming holds at once; a unit of more is split into units that together hold all its pairs.
MOST_SHINGLES = 4 << 20
#: Levels after which a large node of several components is compared whole, which grows with the square of its size.
DEEP = 12
#: A large node is compared whole at once if that makes so many times the pairs of two small ones at most: comparing up
#: to some 4,096 documents takes less than the jobs of another level.
WHOLE = 16
#: So many row numbers may be broadcast to select texts (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: So many links (16 bytes each) are joined to components at once in the driver; more by stars over staged tables.
MOST_COLLECTED = 1 << 17

_RNG = np.random.Generator(np.random.PCG64(75))
_A = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: (document, hash). A text of fewer than k words is one shingle; without words it has none."""
    w = words_of(raw, offsets, lower=True)
    value, doc, _ = windows(w, k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        first = np.cumsum(w.counts) - w.counts
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = w.counts[short] > i
            extra[has] = mix64(extra[has] * BASE + w.hash[first[short[has]] + i])
        value, doc = np.append(value, mix64(extra ^ w.counts[short].astype(np.uint64))), np.append(doc, short)
    d, v, _ = distinct_per_doc(doc, value)
    return d, v


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, two 64-bit fingerprints of the set, minwise tokens); zeros for empty sets."""
    counts = np.bincount(doc, minlength=n)
    some = np.flatnonzero(counts)
    fp1, fp2, sig = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, COORDINATES), np.uint32)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        fp1[some] = np.add.reduceat(mix64(value), starts)
        fp2[some] = np.add.reduceat(mix64(value ^ np.uint64(0xA0761D6478BD642F)), starts)
        for i in range(COORDINATES):
            sig[some, i] = np.minimum.reduceat(((value * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return counts, fp1, fp2, sig


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "text"):
        n = batch.num_rows
        counts, fp1, fp2, sig = signatures(*shingle_sets(*text_buffers(batch.column(batch.schema.get_field_index("text")))), n)
        rows = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * COORDINATES), n, [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()) for x in (sig, sig.astype(np.uint8))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), *rows], [*batch.schema.names, "n_shingles", "fp1", "fp2", "sig", "sketch"])


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), COORDINATES)


def chosen(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The coordinate at which a node branches, and a second one or -1 (for one node in three)."""
    h = mix64(key.astype(np.uint64) + np.uint64((level + 1) * int(BASE) % 2**64))
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    step = 1 + ((h >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)
    return first, np.where((h >> np.uint64(40)) % np.uint64(3) == 0, (first + step) % COORDINATES, -1)


def _branch(level: int):
    """Arrow rows (key, uid, sig) to the rows (key, uid) of the child nodes; at level 0 the rows are (uid, sig) at all roots."""

    def children(key: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in chosen(key, level):
            rows = np.flatnonzero(at >= 0)
            token = sig[rows, at[rows]].astype(np.uint64)
            yield rows, mix64(mix64(key[rows].astype(np.uint64) * BASE + at[rows].astype(np.uint64)) + token).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(batch.schema.get_field_index("sig")), np.uint32)
            uid = batch.column(batch.schema.get_field_index("uid"))
            roots = [np.full(batch.num_rows, t, np.int64) for t in range(TREES)] if level == 0 else [np.asarray(batch.column(0), np.int64)]
            for key in roots:
                for rows, child in children(key, sig):
                    yield pa.RecordBatch.from_arrays([pa.array(child), uid.take(pa.array(rows, pa.int64()))], ["key", "uid"])

    return run


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one unit each, from rows sorted by `unit`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.asarray(batch.column(batch.schema.get_field_index("unit")), np.int64)
        if held and held[-1].column("unit")[-1].as_py() != unit[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for a, b in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(unit):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def proposed(sig: np.ndarray, size: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Of others those whose signatures agree enough with i's and whose set sizes allow the similarity, best first."""
    low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
    others = others[100 * low >= PERCENT * high]
    agree = (sig[others] == sig[i]).sum(1)
    keep = agree >= AGREE
    return others[keep][np.argsort(-agree[keep], kind="stable")]


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep of each unit what signatures can't rule out, split into connected parts that are named by their members.

    Documents of the same root are known to be connected and aren't compared.
    """
    for t in by_unit(batches):
        uid = np.asarray(t["uid"], np.int64)
        order = np.argsort(uid)
        uid, root, size, n = uid[order], np.asarray(t["root"], np.int64)[order], np.asarray(t["n_shingles"], np.int64)[order], len(uid)
        if (root == root[0]).all():
            continue
        sig, label = _matrix(t["sketch"].combine_chunks())[order], np.arange(len(uid))
        for i in range(n - 1):
            for x in np.unique(label[proposed(sig, size, i, i + 1 + np.flatnonzero(root[i + 1 :] != root[i]))]):
                if x != label[i]:
                    label[label == x] = label[i]
        for x in np.unique(label):
            part = np.flatnonzero(label == x)
            if len(part) > 1:
                name = int(np.bitwise_xor.reduce(mix64(uid[part].astype(np.uint64))).view(np.int64))
                whole = [pa.array(np.full(len(part), x, np.int64)) for x in (name, len(part), size[part].sum())]
                yield pa.RecordBatch.from_arrays([whole[0], *[pa.array(x[part]) for x in (uid, root, size)], *whole[1:]], ["unit", "uid", "root", "n_shingles", "n", "held"])


class Sets:
    """The sets of a unit's documents, over the numbers of their shingles, for intersections of one with many at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.ids = np.unique(values, return_inverse=True)[1].astype(np.int32)
        self.flag = np.zeros(len(values) + 1, bool)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """If 100 * intersection >= PERCENT * union of i's set with each of the others'."""
        own = self.ids[self.start[i] : self.start[i] + self.size[i]]
        row, within = ragged(self.size[others])
        self.flag[own] = True
        both = np.bincount(row, weights=self.flag[self.ids[self.start[others][row] + within]], minlength=len(others)).astype(np.int64)
        self.flag[own] = False
        return (both > 0) & (100 * both >= PERCENT * (self.size[i] + self.size[others] - both))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of each unit by links that hold on the full sets, and by roots: (a, b), a being one of them.

    Pairs within a component aren't confirmed again.
    """
    for t in by_unit(batches):
        t = t.combine_chunks()
        uid, size = np.asarray(t["uid"], np.int64), np.asarray(t["n_shingles"], np.int64)
        sig = _matrix(t["sketch"].combine_chunks())
        n, sets = len(uid), []
        for batch in chunked(t.select(["text"]).to_batches(), "text"):
            doc, value = shingle_sets(*text_buffers(batch.column(0)))
            sets += np.split(value, np.cumsum(np.bincount(doc, minlength=batch.num_rows))[:-1])
        held, label = Sets(sets), np.unique(np.asarray(t["root"], np.int64), return_inverse=True)[1]
        for i in range(n - 1):
            apart = proposed(sig, size, i, i + 1 + np.flatnonzero(label[i + 1 :] != label[i]))
            if len(apart):
                for x in np.unique(label[apart[held.similar(i, apart)]]):
                    label[label == x] = label[i]
        order = np.lexsort((uid, label))
        first = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
        count = np.diff(np.append(first, n))
        some = np.repeat(count, count) > 1
        head = np.repeat(uid[order][first], count)
        yield pa.RecordBatch.from_arrays([pa.array(head[some]), pa.array(uid[order][some])], ["a", "b"])


def _bounded(units: DataFrame) -> DataFrame:
    """Units (unit, uid, root, n_shingles) of which none holds more than about MOST_SHINGLES, or two documents, but all pairs of the given ones.

    These have the unit's documents and shingles besides (n, held). A larger unit is dealt into blocks of half that;
    each pair of blocks becomes a unit.
    """
    light, heavy = units.where(F.col("held") <= MOST_SHINGLES), units.where(F.col("held") > MOST_SHINGLES)
    heavy = heavy.withColumn("blocks", F.least("n", F.ceil(2 * F.col("held") / MOST_SHINGLES)))
    heavy = heavy.withColumn("own", F.pmod(F.xxhash64("uid", "unit"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = heavy.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "uid", "root", "n_shingles")
    return light.select("unit", "uid", "root", "n_shingles").unionByName(pairs)


def _links(units: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of comparison units (unit, uid, root). The texts come from sets, where they stand once."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = units.join(signed.select("uid", "n_shingles", "sketch"), "uid").repartition(parts, "unit").sortWithinPartitions("unit")
    kept = staged(met.select("unit", "uid", "root", "n_shingles", "sketch").mapInArrow(_propose, "unit long, uid long, root long, n_shingles long, n long, held long").distinct(), "units")
    wanted = kept.select("uid")
    texts = sets.select("uid", "sketch", "text")
    # rows of a staged table are counted without a shuffle; only many of them are worth one
    if kept.count() <= MOST_BROADCAST or (wanted := wanted.distinct()).count() <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(wanted), "uid", "left_semi")
    full = _bounded(kept).join(texts, "uid").select("unit", "uid", "root", "n_shingles", "sketch", "text")
    return full.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_confirm, "a long, b long")


def _whole(ends: DataFrame) -> DataFrame:
    """Units (unit, uid) in which each document outside of its node's largest component meets all others of the node.

    ends: (key, uid, inside, most, n). Blocks of half a unit from the largest component meet those from outside, and
    these each other.
    """
    half = max(1, SMALL // 2)
    of_inside, of_outside = F.ceil(F.col("most") / half), F.ceil((F.col("n") - F.col("most")) / half)
    own = F.pmod(F.xxhash64("uid", "key"), F.when(F.col("inside"), of_inside).otherwise(of_outside))
    dealt = ends.select("key", "uid", "inside", own.alias("own"), of_inside.alias("i"), of_outside.alias("o"))
    across = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("inside"), F.col("o")).otherwise(F.col("i")) - 1)))
    pair = [F.when(F.col("inside"), F.col("own")).otherwise(F.col("other")), F.when(F.col("inside"), F.col("other")).otherwise(F.col("own"))]
    outside = dealt.where(~F.col("inside") & (F.col("o") > 1)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o") - 1)))
    return across.select(F.xxhash64("key", F.lit(0), *pair).alias("unit"), "uid").unionByName(
        outside.select(F.xxhash64("key", F.lit(1), F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "uid")
    )


def find_links(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between representatives (uid) whose sets are similar, enough to connect all that are found."""
    signed = staged(sets.join(reps, "uid", "left_semi").where(F.col("n_shingles") > 0).select("uid", "n_shingles", "sig", "sketch"), "representatives")
    nodes = signed.select("uid", "sig").mapInArrow(_branch(0), "key long, uid long")
    ends = roots = None
    level = 0
    while True:
        if nodes is None:
            units = ends
        else:
            sized = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            nodes = staged(nodes.join(sized, "key"), f"nodes-{level}")
            block = F.pmod(F.xxhash64("uid", "key"), F.ceil(F.col("n") / SMALL))
            units = nodes.select(F.when(F.col("n") > SMALL, F.xxhash64("key", block)).otherwise(F.col("key")).alias("unit"), "uid")
            if ends is not None:
                units = units.unionByName(ends)
        if roots is None:
            units = units.withColumn("root", F.col("uid"))
        else:
            units = units.join(roots, "uid", "left").select("unit", "uid", F.coalesce("root", "uid").alias("root"))
        links = staged(_links(units, signed, sets), f"links-{level}")
        if roots is not None:
            links = links.unionByName(roots.select(F.col("uid").alias("a"), F.col("root").alias("b")))
        if nodes is None:
            return links
        big = nodes.where(F.col("n") > SMALL)
        if big.isEmpty():
            return links
        level += 1
        roots = components(links)
        # a large node ends when one component holds all of it, or all but few; other large nodes branch with all documents
        rooted = staged(big.join(roots, "uid", "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("root")), f"rooted-{level}")
        held = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n"))
        top = held.groupBy("key").agg(F.max(F.struct("held", "root")).alias("top"), F.first("n").alias("n")).where("top.held < n")
        outside = F.col("n") - F.col("top.held")
        last = (outside <= SMALL // 2) | (outside * F.col("n") <= WHOLE * SMALL * SMALL) | F.lit(level >= DEEP)
        mixed = staged(top.select("key", F.col("top.held").alias("most"), F.col("top.root").alias("top"), last.alias("last")), f"mixed-{level}")
        several, ending = mixed.agg(F.count(F.lit(1)), F.count(F.when(F.col("last"), 1))).first()
        if not several:
            return links
        rest = rooted.join(F.broadcast(mixed) if several <= MOST_BROADCAST else mixed, "key")
        ends = nodes = None
        if ending:
            ends = _whole(rest.where("last").select("key", "uid", (F.col("root") == F.col("top")).alias("inside"), "most", "n"))
        if ending < several:
            nodes = rest.where("not last").join(signed.select("uid", "sig"), "uid").select("key", "uid", "sig").mapInArrow(_branch(level), "key long, uid long")


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the links a, b; root is the smallest node of its component."""
    node, ends = np.unique(np.append(a, b), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(node))
    while len(a):
        # roots that links join point to the least of them, then every node to its last root
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return node, node[root]


def components(links: DataFrame) -> DataFrame:
    """(uid, root) for every node of the links; root is the smallest uid of its component.

    Few links are joined in the driver, which spares some twenty stages; the table that comes of it is below 5 MB.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if links.count() <= MOST_COLLECTED:
        held = links.toArrow()
        uid, root = least_connected(*[np.asarray(held[c], np.int64) for c in ("a", "b")])
        return F.broadcast(links.sparkSession.createDataFrame(pa.table({"uid": pa.array(uid, pa.int64()), "root": pa.array(root, pa.int64())})))
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: every neighbour above u points to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "edges")
        # done when all are stars: nobody points to two, or to one that points on
        pointing = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if pointing.where("n > 1").isEmpty() and edges.join(pointing.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("uid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("uid"), F.col("v").alias("root")).distinct())


def grouped(docs: DataFrame, *, keep_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sets: uid, doc_id, text, n_shingles, ..., and the row's other columns as `rest` if wanted; groups: uid, component_id, first_uid per row with shingles)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] if keep_row else []
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text"), *rest)
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    sets = staged(rows.mapInArrow(_sets, f"{schema}, n_shingles long, fp1 long, fp2 long, sig binary, sketch binary"), "sets")
    some = sets.where(F.col("n_shingles") > 0).select("uid", "doc_id", "n_shingles", "fp1", "fp2")
    classes = staged(some.groupBy("n_shingles", "fp1", "fp2").agg(F.min("uid").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")), "classes")
    roots = components(find_links(sets, classes.select(F.col("rep").alias("uid"))))
    rooted = classes.join(roots.withColumnRenamed("uid", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    first = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = rooted.join(first, "root").select("n_shingles", "fp1", "fp2", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("first_uid"))
    return sets, some.join(named, ["n_shingles", "fp1", "fp2"]).select("uid", "component_id", "first_uid")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Links need 100 * intersection >= 75 * union of the sets of distinct 5-word shingles (letters A-Z lower-cased), each of
    which stands in its set as 52 bits of a hash of all its words: of a text of a million words, two shingles share
    theirs with a chance of one in ten thousand, and then count as one.
    Null, empty and wordless texts have empty sets and are linked with nothing. A null doc_id never names a component
    that has another; a row without doc_id is kept if its component_id is null too. Repeated rows are linked like
    copies. Texts of any length are compared whole. An empty table gives no rows; other columns are never read.
    """
    sets, groups = grouped(docs)
    out = sets.select("uid", "doc_id", "n_shingles").join(groups, "uid", "left")
    component = F.when(F.col("first_uid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each stands for its group: that of the smallest doc_id, one of repeated rows.

    Null, empty and wordless texts stay, as they are in no group; a null doc_id stands for a group only where no other
    does. Other columns may have any names and types. An empty table stays empty.
    """
    sets, groups = grouped(docs, keep_row=True)
    silent = staged(groups.where(F.col("first_uid") != F.col("uid")).select("uid"), "silent")
    if silent.count() <= MOST_BROADCAST:
        silent = F.broadcast(silent)
    kept = sets.select("uid", "text", "rest").join(silent, "uid", "left_anti")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
