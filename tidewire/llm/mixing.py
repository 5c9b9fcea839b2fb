"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source, documents are ordered by that key through key ranges (a hash
is uniform, so equal ranges hold equal shares and no sampling pass is needed); the sums of the ranges give each range
its offset, in two levels, so that no task holds more than a few thousand ranges of a source; and a running sum inside
the range gives each document its place on the source's line of words. The mix takes the line from its start, over again
for each epoch, and stops exactly at the source's budget.

Targets need the order of all sources, so one task holds one row of some 100 bytes for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import staged, words

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Key ranges of a source whose offsets one task sums up.
RANGES = 4096
#: Between a space and a word.
WORD_STARTS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: (src_null, src, docs, source_size, target).

    Sources by code point, null last, take the weights in turn. The total is share times all sizes; a target stops at
    cap times its source's size and the excess goes to the others by weight. That fixpoint is min(cap * size, level *
    weight) for one level: with sources in the order of cap * size / weight, the first k are capped. The windows here
    run over one row per source, after the documents are summed up.
    """
    per_source = sized.groupBy("src_null", "src").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn("rank", F.row_number().over(everything.orderBy("src_null", "src")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    by_level = everything.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.col("total") - before) / left)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return ranked.withColumn("final", level).select("src_null", "src", "docs", "source_size", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def mix_plan(sized: DataFrame, *, bucket_docs: int = 4096, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds source_size, target and taken to rows with (doc_id, src_null, src, size, ...).

    bucket_docs: documents that a key range holds on average. A hot source has many ranges; each is one window group.
    """
    sources = staged(source_targets(sized.select("src_null", "src", "size"), weights=weights, share=share, cap=cap), "mix-sources")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    part: Column = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    keyed = (
        sized.withColumn("mix_key", key)
        .join(sources.withColumnsRenamed({"src": "s_src", "src_null": "s_null"}), (F.col("src") == F.col("s_src")) & (F.col("src_null") == F.col("s_null")))
        .drop("s_src", "s_null")
        .withColumn("bucket", F.floor(part * F.ceil(F.col("docs") / F.lit(float(bucket_docs)))))
    )
    sums = keyed.groupBy("src_null", "src", "bucket").agg(F.sum("size").alias("words"))
    sums = staged(sums.withColumn("upper", F.floor(F.col("bucket") / RANGES)), "mix-ranges")
    before = lambda *keys: Window.partitionBy("src_null", "src", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    uppers = sums.groupBy("src_null", "src", "upper").agg(F.sum("words").alias("words"))
    uppers = uppers.select("src_null", "src", "upper", F.coalesce(F.sum("words").over(before("upper")), F.lit(0)).alias("base"))
    lower = F.coalesce(F.sum("words").over(before("upper", "bucket")), F.lit(0))
    offsets = sums.withColumn("lower", lower).join(uppers, ["src_null", "src", "upper"]).select(F.col("src_null").alias("o_null"), F.col("src").alias("o_src"), F.col("bucket").alias("o_bucket"), (F.col("base") + F.col("lower")).alias("offset"))
    placed = keyed.join(offsets, (F.col("src") == F.col("o_src")) & (F.col("src_null") == F.col("o_null")) & (F.col("bucket") == F.col("o_bucket")))
    within = Window.partitionBy("src_null", "src", "bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.withColumn("taken", taken.cast("long")).drop("mix_key", "bucket", "docs", "o_src", "o_null", "o_bucket", "offset", "start")


def sized_documents(docs: DataFrame, *, keep_row: bool = False) -> DataFrame:
    """(doc_id, src_null, src, size), and the whole row as struct `row` if wanted; other columns can't clash."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []
    return docs.select("doc_id", F.col("source").isNull().alias("src_null"), F.coalesce("source", F.lit("")).alias("src"), F.size(words(F.col("text"))).cast("long").alias("size"), *whole)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    Nulls: a null text has no words and is never taken; null sources form one source, the last; a null doc_id is keyed
    like any value. Repeated rows are documents of their own that stand side by side. Of a text of any length only the
    number of its words goes on. An empty table gives no rows; other columns are never read.
    """
    sized = staged(sized_documents(docs), "mix-sized")
    return mix_plan(sized, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, once for each time the mix takes the whole text, and the cut document's text up to its last word in the mix.

    Nulls and repeats as in mix_sources; rows without words aren't in the mix. Other columns may have any names. An
    empty table stays empty.
    """
    plan = mix_plan(sized_documents(docs, keep_row=True), **options)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))
    copies = F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))
    copies = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    rows = plan.select("row", F.explode(copies).alias("cut"))
    text = F.col("row.text")
    starts_blank = text.rlike(r"\A[\x20\x09-\x0D]").cast("int")
    first = F.slice(F.split(text, WORD_STARTS), 1, (F.greatest(F.col("cut"), F.lit(1)) + starts_blank).cast("int"))
    cut_text = F.regexp_replace(F.array_join(first, ""), r"[\x20\x09-\x0D]+\z", "")
    out = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == "text":
            value = F.when(F.col("cut") < 0, value).otherwise(cut_text)
        elif c == "n_chars":
            value = F.when(F.col("cut") < 0, value).otherwise(F.length(cut_text).cast("long"))
        out.append(value.alias(c))
    return rows.select(*out)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3] AS DOUBLE) AS w,
         2.0 * source_size::DOUBLE AS most, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS r FROM per),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (
  SELECT source, source_size, least(most, coalesce(w * max(CASE WHEN level * w <= most THEN level END) OVER (), most)) AS target FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END * size
  + greatest(0, least(size, CAST(floor(target) AS BIGINT)
      - (CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END) * source_size - start)) AS taken
FROM placed
"""
