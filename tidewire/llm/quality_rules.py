"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Rules are taken as independent given the document's true class;
a rule's accuracy is how often it casts each vote on good and on bad documents. Expectation-maximisation estimates the
accuracies and the share of good documents from the counts of vote patterns, of which there are at most 3 to the
number of rules whatever the input. The posterior probability of "good" then takes the place of an all-rules-must-pass
filter.

The repeated 3-word windows of a text are found inside its row: each window is a 64-bit value whose upper bits are a
hash of its words and whose lower bits are its place, so one sort of plain longs puts equal windows side by side. Windows
of equal hashes are then compared word by word, so the counts are exact for texts of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACES, staged, words

#: name: (column condition for a good vote, for a bad vote); SQL that Spark and DuckDB share.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "symbols": ("20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "symbol_runs": ("20 * n_symbol_runs <= n_words", "6 * n_symbol_runs > n_words"),
    "symbol_chars": ("200 * n_symbols <= word_chars", "25 * n_symbols > word_chars"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    "lines": ("n_dup_lines = 0 AND n_lines >= 3", "2 * n_dup_lines > n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    "upper": ("5 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    "marks": ("10 * n_marks <= n_words", "2 * n_marks > n_words"),
}
ITERATIONS, PRIOR = 12, 0.8
#: Where EM starts: the probability of each vote (bad, none, good) on a good and on a bad document. Bad documents mostly
#: break one rule and keep the others. The same values are the prior that PULL, a share of all documents, weighs: without
#: it EM may settle on any two clusters, such as one kind of junk against all else.
START, PULL = ((0.01, 0.24, 0.75), (0.25, 0.15, 0.6)), 0.1
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def text_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, n_symbol_runs (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col(key), text.alias("t"), words(F.col("text")).alias("w"))
    sized = split.select(key, "t", "w", F.size("w").cast("long").alias("n_words"), F.length(F.bin(F.size("w").cast("long"))).alias("b"))
    windows = "sort_array(transform(slice(w, 1, greatest(cast(n_words as int) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, w[i + 1], w[i + 2]), b) | cast(i as bigint)))"
    # get() is null beyond either end, and a null comparison is no match
    repeated = "filter(s, (x, i) -> shiftright(x, b) = shiftright(get(s, i - 1), b) or shiftright(x, b) = shiftright(get(s, i + 1), b))"
    # of the windows with equal hashes, which are few in most texts, the words themselves
    worded = f"sort_array(transform(transform({repeated}, x -> cast(x & (shiftleft(1L, b) - 1L) as int)), x -> struct(concat_ws(' ', w[x], w[x + 1], w[x + 2]) as k, cast(x as bigint) as i)))"
    places = "sort_array(transform(filter(e, (x, j) -> x.k = get(e, j - 1).k or x.k = get(e, j + 1).k), x -> x.i))"
    covered = "aggregate(transform(p, (x, i) -> least(3L, coalesce(get(p, i + 1) - x, 3L))), 0L, (a, x) -> a + x)"
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    marks = F.length("t") - F.length(F.translate("t", "!?", ""))
    upper = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))
    runs = F.length(F.regexp_replace("t", "[#*$%&|<>]+", "#")) - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))
    symbols = F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))
    measured = sized.select(key, "n_words", "b", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), runs.cast("long").alias("n_symbol_runs"), lines.alias("l"), upper.cast("long").alias("n_upper"), marks.cast("long").alias("n_marks"), F.expr(windows).alias("s"), "w")
    placed = measured.withColumn("e", F.expr(worded)).withColumn("p", F.expr(places))
    return placed.select(key, "n_words", "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.expr(covered).alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"), "n_upper", "n_marks", "n_symbol_runs")


def votes(stats: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """Adds a column vote_<rule> of 1, -1 or 0 for each rule."""
    return stats.select("*", *[F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END").alias(f"vote_{name}") for name, (good, bad) in rules.items()])


def fit(voted: DataFrame, names: list[str]) -> tuple[float, list[list[float]]]:
    """(log odds of a good document, for each rule the log odds that each of its votes -1, 0, 1 adds) by EM over the counts of vote patterns."""
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*[f"vote_{n}" for n in names]).count().collect())
    total = sum(n for _, n in patterns)
    prior, accuracy = PRIOR, [START] * len(names)
    for _ in range(ITERATIONS if total else 0):
        good = []
        for p, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(a[0][v + 1] / a[1][v + 1]) for a, v in zip(accuracy, p, strict=True))
            good.append(n / (1 + math.exp(-odds)))
        mass = sum(good)
        prior = (mass + 1) / (total + 2)
        accuracy = []
        pull = PULL * total
        for j in range(len(names)):
            on_good = [sum(g for g, (p, _) in zip(good, patterns, strict=True) if p[j] == v) for v in (-1, 0, 1)]
            on_bad = [sum(n - g for g, (p, n) in zip(good, patterns, strict=True) if p[j] == v) for v in (-1, 0, 1)]
            accuracy.append((tuple((x + pull * s) / (mass + pull) for x, s in zip(on_good, START[0], strict=True)), tuple((x + pull * s) / (total - mass + pull) for x, s in zip(on_bad, START[1], strict=True))))
    return math.log(prior / (1 - prior)), [[math.log(g / b) for g, b in zip(*a, strict=True)] for a in accuracy]


def posterior(prior: float, weights: list[list[float]], names: list[str]) -> Column:
    odds = F.lit(prior)
    for name, (bad, none, good) in zip(names, weights, strict=True):
        odds = odds + F.when(F.col(f"vote_{name}") == 1, good).when(F.col(f"vote_{name}") == -1, bad).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality_posterior.

    A null text has no words and no lines, fails the base test and is not kept; an empty table has no rows. Repeated
    rows are judged each. Texts of any length are read whole, in one row's arrays. The fit is to all rows, so it is the
    same in any order of the rows. Other columns are never read and may have any names.
    """
    names = list(rules)
    voted = staged(votes(text_stats(docs), rules), "votes")
    prior, weights = fit(voted, names)
    good = posterior(prior, weights, names)
    failed = F.expr(BASE_FAILED)
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (good >= 0.5)).alias("kept"), good.alias("quality_posterior"))


def oracle_sql(rules: dict[str, tuple[str, str]] = RULES) -> str:
    """The whole operator in DuckDB: one pair of common table expressions for each EM iteration."""
    cols = [f"vote_{n}" for n in rules]
    case = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS vote_{n}" for n, (good, bad) in rules.items())
    out = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY doc_id),
stats AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS BIGINT) AS n_marks,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]+')) AS BIGINT) AS n_symbol_runs
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
voted AS MATERIALIZED (SELECT *, {case} FROM stats),
pats AS MATERIALIZED (SELECT {", ".join(cols)}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL),
m0 AS (SELECT CAST({PRIOR} AS DOUBLE) AS prior, {", ".join(f"CAST({START[y][v + 1]} AS DOUBLE) AS a_{n}_{y}_{v + 1}" for n in rules for y in (0, 1) for v in (-1, 0, 1))})"""
    weight = "CASE vote_{n} WHEN 1 THEN ln(a_{n}_0_2 / a_{n}_1_2) WHEN -1 THEN ln(a_{n}_0_0 / a_{n}_1_0) ELSE ln(a_{n}_0_1 / a_{n}_1_1) END"
    odds = "ln(prior / (1 - prior)) + " + " + ".join(weight.format(n=n) for n in rules)
    for i in range(ITERATIONS):
        share = ", ".join(f"(coalesce(sum(CASE WHEN vote_{n} = {v} THEN {('g', 'n - g')[y]} END), 0) + {PULL} * sum(n) * {START[y][v + 1]}) / (sum({('g', 'n - g')[y]}) + {PULL} * sum(n)) AS a_{n}_{y}_{v + 1}" for n in rules for y in (0, 1) for v in (-1, 0, 1))
        out += f""",
e{i} AS (SELECT p.*, n / (1 + exp(-({odds}))) AS g FROM pats p, m{i}),
m{i + 1} AS MATERIALIZED (SELECT (sum(g) + 1) / (sum(n) + 2) AS prior, {share} FROM e{i})"""
    return out + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM voted, m{ITERATIONS}"""
