"""Sequences, duplicates, frontiers, gaps, order and replay over batch DataFrames.

`deduplicate`, `frontiers` and `in_order` are the declarative forms: they equal the windowed fold as long as no arrival
is a whole window ahead of the frontier (see `folds` for the exact fold).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Values of the ordering column in a range; a task sorts the rows of one key and one range.
SPAN = 1 << 20
#: Up to so many bytes of input, a key of any share is sorted in one task, which spares the pass that counts ranges.
ONE_TASK = 256 << 20


def _fits_one_task(df: DataFrame) -> bool:
    """If the tables that df reads are known to be small; those of unknown size count as large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) <= ONE_TASK


def _carried(df: DataFrame, keys: Sequence[str], by: str, span: int, value: Column, carry: Callable[[WindowSpec], Column]) -> DataFrame:
    """df with `_range`, the range of `by` (nulls first), and `_carry`, found over one row `_v` = value per key and range."""
    ranged = df.withColumn("_range", F.coalesce(F.expr(f"`{by}` div {span}"), F.lit(-(1 << 63))))
    per = ranged.groupBy(*keys, "_range").agg(value.alias("_v"))
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "_range"])}
    found = per.withColumn("_carry", carry(Window.partitionBy(*keys).orderBy("_range"))).select(*[F.col(k).alias(n) for k, n in names.items()], "_carry")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return ranged.join(found, reduce(and_, same)).drop(*names.values())


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, span: int | None = None) -> DataFrame:
    """A dense sequence from 1 per key.

    With a span, keys may be too large for one task: unless the input is small, the first ordering column, of whole
    numbers, is cut into ranges of so many values, rows are numbered within their range, and the counts of the ranges
    before are added. The numbers are the same either way if the order has no ties.
    """
    if span is None or _fits_one_task(df):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    before = _carried(df, keys, order[0], span, F.count(F.lit(1)), lambda w: F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return before.withColumn(name, (place + F.coalesce("_carry", F.lit(0))).cast("long")).drop("_range", "_carry")


def deduplicate(df: DataFrame, identity: Sequence[str], arrival: str = "arrival") -> DataFrame:
    """The first arrival of each identity."""
    w = Window.partitionBy(*identity).orderBy(arrival)
    return df.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")


def frontiers(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Per key the end of the island of sequences that starts at 1, or 0."""
    held = number(df.select(*keys, seq).distinct(), keys, [seq], "_n", SPAN)
    return held.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(seq) == F.col("_n"), F.col(seq))), F.lit(0)).cast("long").alias("frontier"))


def gaps(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Missing ranges between the sequences that are there."""
    held = df.select(*keys, seq).distinct()
    if _fits_one_task(df):
        held = held.withColumn("_next", F.lead(seq).over(Window.partitionBy(*keys).orderBy(seq)))
    else:
        held = _carried(held, keys, seq, SPAN, F.min(seq), lambda w: F.lead("_v").over(w))
        within = F.lead(seq).over(Window.partitionBy(*keys, "_range").orderBy(seq))
        held = held.withColumn("_next", F.coalesce(within, "_carry"))
    return held.where(F.col("_next") - F.col(seq) > 1).select(*keys, (F.col(seq) + 1).alias("gap_from"), (F.col("_next") - 1).alias("gap_to"))


def in_order(df: DataFrame, keys: Sequence[str], seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """Distinct messages up to the frontier, with the place at which strict ordering delivers them."""
    first = deduplicate(df, [*keys, seq], arrival)
    held = first.join(frontiers(first, keys, seq), list(keys)).where(F.col(seq) <= F.col("frontier")).drop("frontier")
    return number(held, keys, [seq], "position", SPAN)


def evict_acked(buffer: DataFrame, acks: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Buffered entries above the highest cumulative acknowledgement."""
    top = acks.groupBy(key).agg(F.max("acked").alias("_acked"))
    return buffer.join(top, key, "left").where(F.col(seq) > F.coalesce("_acked", F.lit(0))).drop("_acked")


def replay(buffer: DataFrame, resumes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Answer resume requests (key, last, highest): entries above `last`, or one gap row with the first available sequence.

    Caught up: nothing. Empty buffer while behind: a gap at highest + 1. Before the buffer's head: a gap at the head.
    """
    head = buffer.groupBy(key).agg(F.min(seq).alias("_head"))
    asked = resumes.join(head, key, "left").where(F.col("last") < F.col("highest"))
    gap = F.when(F.col("_head").isNull(), F.col("highest") + 1).when(F.col("last") + 1 < F.col("_head"), F.col("_head"))
    asked = asked.withColumn("_gap", gap)
    lost = asked.where("_gap is not null").select(key, F.lit("gap").alias("kind"), F.col("_gap").alias(seq))
    sent = asked.where("_gap is null").join(buffer, key).where(F.col(seq) > F.col("last")).select(key, F.lit("entry").alias("kind"), seq)
    return lost.unionByName(sent)


def advanced(df: DataFrame, keys: Sequence[str], order: str, frontier: str) -> DataFrame:
    """Rows at which the frontier is above the one before: where an acknowledgement goes out."""
    before = F.lag(frontier).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col(frontier) > F.col("_b")).drop("_b")


def running_frontier(df: DataFrame, keys: Sequence[str], seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """Adds the frontier after each arrival: n where all of 1 to n are there.

    A sequence counts from the arrival at which it and all below it are there, the running maximum of first arrivals
    in the order of sequences; the frontier at an arrival is how many sequences count by then.
    """
    first = df.groupBy(*keys, seq).agg(F.min(arrival).alias("_at"))
    by_seq = Window.partitionBy(*keys).orderBy(seq)
    ready = first.withColumn("_n", F.row_number().over(by_seq)).where(F.col("_n") == F.col(seq)).withColumn("_ready", F.max("_at").over(by_seq))
    marks = ready.groupBy(*keys, F.col("_ready").alias(arrival)).agg(F.max(seq).alias("_up"))
    joined = df.join(marks, [*keys, arrival], "left")
    return joined.withColumn("frontier", F.coalesce(F.max("_up").over(Window.partitionBy(*keys).orderBy(arrival)), F.lit(0)).cast("long")).drop("_up")


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 64) -> DataFrame:
    """The write batch of each row: at most so many rows go out together."""
    return number(df, keys, order, "_n", SPAN).withColumn("batch", F.ceil(F.col("_n") / F.lit(most)).cast("long")).drop("_n")
