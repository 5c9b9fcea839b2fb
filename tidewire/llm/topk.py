"""Exact top-k search by pivot-table elimination.

Vectors become integer vectors floor(64 * x). Every vector's distances to a fixed number of pivots are computed once
and kept beside it. By the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) for each pivot p, so the largest such
difference bounds the distance from below and, with the norms, the inner product from above. Within a block pair each
query evaluates candidates in the order of that bound and stops when no bound reaches its k-th best score, so the
result is exact. Queries and candidates are dealt out in blocks; the best k of each block pair are merged. While all
blocks of queries together are small they are broadcast, and no candidate moves; otherwise pairs of blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, staged

#: The pivots are this many vectors, those of the smallest hash; any choice gives the same result.
PIVOTS = 16
CANDIDATES, QUERIES, FIRST = 8192, 1024, 256
#: Bytes of all blocks of queries up to which they are broadcast.
MOST_BROADCAST = 32 << 20


def quantized(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, q array<long>) of the rows without null or non-finite components; uid tells repeated rows apart."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select("vec_id", F.col("embedding")).where(fine).select(F.monotonically_increasing_id().alias("uid"), "vec_id", x.alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to the width."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pack(width: int, pivots: np.ndarray, rows: int | None):
    """Arrow rows (uid, vec_id, q) to blocks: number of the task, n, uids, ids, id_null, vectors, squared norms, pivot distances; one block for a task if rows is None."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        v = _matrix(t.column("q").combine_chunks(), width)
        f = v.astype(float)
        norm = (f * f).sum(1)
        ids = t.column("vec_id").combine_chunks()
        far = np.sqrt(np.maximum(norm[:, None] + (pivots * pivots).sum(1)[None] - 2 * f @ pivots.T, 0)) if len(pivots) else np.zeros((len(v), 0))
        parts = [np.asarray(t.column("uid"), np.int64), np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()).astype(np.int8), v, norm, far]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (np.int32(TaskContext.get().partitionId()), len(v), *[np.ascontiguousarray(p).tobytes() for p in parts])], ["no", "n", "uids", "ids", "nulls", "v", "norm", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at) if rows is None else batch.slice(at, rows - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


BLOCK = "no int, n long, uids binary, ids binary, nulls binary, v binary, norm binary, far binary"


def _unpack(row: dict, prefix: str, width: int) -> tuple[np.ndarray, ...]:
    n = row[f"{prefix}n"]
    get = lambda name, kind: np.frombuffer(row[f"{prefix}{name}"], kind)
    return get("uids", np.int64), get("ids", np.int64), get("nulls", np.int8), get("v", np.int64).reshape(n, width), get("norm", float), get("far", float).reshape(n, -1)


def search_block(queries: tuple, candidates: tuple, k: int, first: int = FIRST) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per query: (uid, vec_id, candidates' ids, their nulls, scores) of its best k in this block, in any order."""
    q_uid, q_id, _, q_v, q_norm, q_far = queries
    c_uid, c_id, c_null, c_v, c_norm, c_far = candidates
    width = q_v.shape[1]
    exact = width * float(np.abs(q_v).max(initial=0)) * float(np.abs(c_v).max(initial=0)) < 2**52
    left, right = (q_v.astype(float), c_v.astype(float)) if exact else (q_v, c_v)
    out = []
    for at in range(0, len(q_uid), 64):
        part = slice(at, at + 64)
        lower = np.zeros((len(q_uid[part]), len(c_uid)))
        for p in range(q_far.shape[1]):
            np.maximum(lower, np.abs(q_far[part, p, None] - c_far[None, :, p]), out=lower)
        # rounding: distances are right to about 1e-12 of their size, the slack is far above that
        slack = 1 + 1e-9 * (q_norm[part, None] + c_norm[None])
        upper = (q_norm[part, None] + c_norm[None] - lower * lower) / 2 + slack
        for i in range(len(lower)):
            bound, me = upper[i], at + i
            todo = np.argpartition(-bound, first)[:first] if len(bound) > first else np.arange(len(bound))
            todo = todo[c_uid[todo] != q_uid[me]]
            score = right[todo] @ left[me]
            least = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
            if len(bound) > first:
                rest = bound >= least
                rest[todo] = False
                more = np.flatnonzero(rest)
                more = more[c_uid[more] != q_uid[me]]
                more = more[np.argsort(-bound[more])]
                while len(more) and bound[more[0]] >= least:  # in the order of the bounds, until none can reach the k-th best
                    now, more = more[: 4 * first], more[4 * first :]
                    todo, score = np.append(todo, now), np.append(score, right[now] @ left[me])
                    least = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
            best = np.flatnonzero(score >= least)
            best = best[np.lexsort((c_id[todo[best]], c_null[todo[best]], -score[best]))][:k]
            out.append((int(q_uid[me]), int(q_id[me]), c_id[todo[best]], c_null[todo[best]], np.rint(score[best]).astype(np.int64) if exact else score[best]))
    return out


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id, score of the k best other rows.

    Ties go to the smaller vec_id, null last. Vectors that are null or hold null or non-finite components take no part;
    shorter vectors count as filled up with zeros. Repeated rows are rows of their own: a repeated query is answered
    for each row, and a repeated candidate is found as often. With k or fewer others all are returned; an empty table
    gives no rows. Other columns are never read. Scores are exact; ArithmeticError is raised where one could pass 64 bits.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    table = staged(quantized(vectors), "vectors")
    largest = F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))
    width, rows, most = table.agg(F.max(F.size("q")), F.count(F.lit(1)), F.max(largest)).first()
    width = max(int(width or 0), 1)
    if width * (most or 0.0) ** 2 >= 2.0**63:
        raise ArithmeticError(f"components up to {most:.0f} in {width} dimensions may give scores beyond 64 bits")
    chosen = table.orderBy(F.xxhash64("uid"), "uid").limit(PIVOTS).toPandas()["q"]
    pivots = np.zeros((len(chosen), width))
    for i, p in enumerate(chosen):
        pivots[i, : len(p)] = p
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = staged(table.repartition(-(-rows // candidates) or 1).mapInArrow(_pack(width, pivots, candidates), BLOCK), "candidate-blocks")
    blocks = -(-rows // (every * queries)) or 1
    asked = staged(table.where(F.col("vec_id") % every == 0).repartition(blocks).mapInArrow(_pack(width, pivots, None), BLOCK), "query-blocks")
    # one row for each pair of blocks: every block of queries must meet every block of candidates
    c = packed.select(*[F.col(x).alias(f"c_{x}") for x in packed.columns]).withColumn("q_no", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = asked.select(*[F.col(x).alias(f"q_{x}") for x in asked.columns])
    held = asked.agg(F.sum(sum((F.length(x) for x in ("uids", "ids", "nulls", "v", "norm", "far")), F.lit(0)))).first()[0] or 0
    pairs = c.join(F.broadcast(q), "q_no") if held <= MOST_BROADCAST else c.join(q, "q_no").repartition(max(tasks, blocks * (-(-rows // candidates))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = search_block(_unpack(row, "q_", width), _unpack(row, "c_", width), k)
                sizes = [len(x[4]) for x in found]
                if not sum(sizes):
                    continue
                uid, qid = (np.repeat(np.array([x[j] for x in found], np.int64), sizes) for j in (0, 1))
                ids, nulls, score = (np.concatenate([x[j] for x in found]) for j in (2, 3, 4))
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(qid), pa.array(ids, mask=nulls.astype(bool)), pa.array(score, pa.int64())], ["uid", "query_id", "vec_id", "score"])

    local = pairs.mapInArrow(run, "uid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
