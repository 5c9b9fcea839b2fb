"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on labelled statistics; every path from a root to a node is a conjunctive rule. A lasso
logistic regression weighs the rules and drops most. The rules that remain are compiled into one Spark column over the
statistics, so scoring is a projection. The statistics come from one Arrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunked, staged, text_buffers
from tidewire.llm.textarrays import IS_SPACE, distinct_per_doc, powers, windows, words_of

FEATURES = (
    "log_words", "word_chars", "symbols", "upper", "digits", "marks", "stops", "distinct", "top_word", "repeats", "dup_lines", "line_words", "longest", "non_ascii", "capital_words",
)
#: The fit sees at most so many labelled rows, those of the smallest hash of doc_id.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, PENALTY, STEPS = 40, 3, 32, 0.2, 0.002, 400

_SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK, _STOP, _STARTS = (np.zeros(256, bool) for _ in range(7))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_DIGIT[list(b"0123456789")] = True
_MARK[list(b"!?")] = True
_STOP[list(b".,;:")] = True
_STARTS[[i for i in range(256) if i & 0xC0 != 0x80]] = True  # first bytes of UTF-8 characters


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; a text without words has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    w = words_of(raw, offsets)
    per = np.maximum(w.counts, 1).astype(float)
    chars = count(_STARTS & ~IS_SPACE)
    starts = count(_STARTS)
    out[:, 0] = np.log1p(w.counts)
    out[:, 1] = chars / per
    out[:, 2] = count(_SYMBOL) / per
    out[:, 3] = count(_UPPER) / np.maximum(count(_LETTER), 1)
    out[:, 4] = count(_DIGIT) / np.maximum(chars, 1)
    out[:, 5] = count(_MARK) / per
    out[:, 6] = count(_STOP) / per
    d, _, times = distinct_per_doc(w.doc, w.hash)
    out[:, 7] = np.bincount(d, minlength=n) / per
    np.maximum.at(out[:, 8], d, times)
    out[:, 8] /= per
    wd, wh, wt = distinct_per_doc(*windows(w, 3)[1::-1])
    out[:, 9] = np.bincount(wd, weights=wt * (wt > 1), minlength=n) / per
    # lines: hash by the words that they hold, with the place of each word in its line
    new_line = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 0x0A, out=new_line[1:])
    if len(w.start):
        line = new_line[w.start]
        first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])))
        size = np.diff(np.append(first, len(line)))
        place = np.arange(len(line)) - np.repeat(first, size)
        hashed = np.add.reduceat(w.hash * powers(int(size.max()))[place], first)
        ld, _, lt = distinct_per_doc(w.doc[first], hashed)
        lines = np.maximum(np.bincount(w.doc[first], minlength=n), 1)
        out[:, 10] = np.bincount(ld, weights=lt - 1, minlength=n) / lines
        out[:, 11] = np.minimum(w.counts / lines, 200)
        np.maximum.at(out[:, 12], w.doc, w.length)
        out[:, 14] = np.bincount(w.doc, weights=_UPPER[raw[w.start]], minlength=n) / per
    out[:, 12] = np.log1p(out[:, 12])
    out[:, 13] = 1 - count(np.arange(256) < 128) / np.maximum(starts, 1)
    out[w.counts == 0] = 0
    return out


def with_statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """The kept columns, and a column f_<feature> for each statistic of `text`; a null text counts as empty."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = rows.columns[:-1]
    fields = ", ".join(f"f_{f} double" for f in FEATURES)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "__text"):
            values = statistics(*text_buffers(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(values[:, i]) for i in range(len(FEATURES))]], [*kept, *[f"f_{f}" for f in FEATURES]])

    return rows.mapInArrow(run, f"{schema}, {fields}")


@dataclass(frozen=True)
class Rules:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold))); a rule: ((feature, is_above, bound), ...)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            held = None
            for f, above, bound in conditions:
                one = F.col(f"f_{FEATURES[f]}") > bound if above else F.col(f"f_{FEATURES[f]}") <= bound
                held = one if held is None else held & one
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, bound in conditions:
        out &= x[:, f] > bound if above else x[:, f] <= bound
    return out


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: tuple, depth: int, paths: list, step: np.ndarray) -> None:
    """Grow one tree: each node's path goes to paths, each leaf's Newton step to its rows of step."""
    g, h = grad[rows].sum(), curve[rows].sum()
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, curve[rows], len(edges[f]) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(hl < 1) | (h - hl < 1)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return
    f, k = best[1]
    low = binned[rows, f] <= k
    for above, part in ((False, rows[low]), (True, rows[~low])):
        further = (*path, (f, above, float(edges[f][k])))
        paths.append(further)
        _grow(x, binned, edges, grad, curve, part, further, depth - 1, paths, step)


def _simple(conditions: tuple) -> tuple:
    """One bound per feature and side, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, above, bound in conditions:
        old = tight.get((f, above))
        tight[f, above] = bound if old is None else (max if above else min)(old, bound)
    return tuple((f, above, bound) for (f, above), bound in sorted(tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules from labelled statistics; with labels of one kind only, a constant score (0.5 without any)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, binned, edges, p - y, p * (1 - p), np.arange(len(y)), (), DEPTH, paths, step)
        margin += RATE * step
    unique: dict[bytes, tuple] = {}
    for conditions in sorted({_simple(c) for c in paths}, key=lambda c: (len(c), c)):
        held = _holds(x, conditions)
        if 0 < held.sum() < len(y):
            unique.setdefault(np.packbits(held).tobytes(), conditions)
    rules = list(unique.values())
    z = np.stack([_holds(x, c) for c in rules], axis=1).astype(np.float64)
    scale = np.maximum(z.std(0), 0.02)
    centred = (z - z.mean(0)) / scale
    # FISTA for the lasso logistic loss; the bias is free
    bound = 0.25 * (np.linalg.norm(centred, 2) ** 2 / len(y) + 1)
    beta = move = np.zeros(len(rules))
    bias = bias_move = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        err = 1 / (1 + np.exp(-(centred @ move + bias_move))) - y
        new = move - centred.T @ err / len(y) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / bound, 0)
        new_bias = bias_move - err.mean() / bound
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        move, bias_move = new + (t - 1) / t_next * (new - beta), new_bias + (t - 1) / t_next * (new_bias - bias)
        beta, bias, t = new, new_bias, t_next
    weights = beta / scale
    bias -= float(weights @ z.mean(0))
    return Rules(float(bias), tuple((c, float(w)) for c, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of doc_id as text is 1 modulo 3; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def marked(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, y) of at most `most` labelled documents, none held out; small enough to be broadcast."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    return F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most))


def fit_on(features: DataFrame, labels: DataFrame) -> Rules:
    """Fit on the marked rows of features (doc_id, f_...): of rows that share a doc_id one, that of the least statistics."""
    names = [f"f_{f}" for f in FEATURES]
    chosen = features.join(marked(labels), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("f")).select("doc_id", "y", "f.*")
    rows = chosen.toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit_rules(rows[names].to_numpy(float), rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts have zero statistics and the score that the rules give those; repeated rows are scored each;
    without labels every score is 0.5 (and predicted 1). Texts of any length are read whole, some ten arrays of their words at once. An
    empty table gives no rows. Other columns of docs or labels are never read.
    """
    features = staged(with_statistics(docs, F.col("doc_id")), "statistics")
    score = fit_on(features, labels).column()
    scored = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is at least 0.5.

    Null and empty texts are judged by their zero statistics, repeated rows each; without labels all rows stay. Other
    columns may have any names and types. An empty table stays empty.
    """
    labelled = docs.join(marked(labels).select("doc_id"), "doc_id", "left_semi")
    rules = fit_on(staged(with_statistics(labelled, F.col("doc_id")), "statistics"), labels)
    rows = with_statistics(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.where(rules.column() >= 0.5).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
