"""Quality rules whose cutoffs are chosen by risk control.

A rule rejects a document when a ratio of its statistics exceeds a cutoff.  The rules
of a stratum tighten together: at step t a rule's cutoff lies t times the spread of
its ratio above the median, both taken from all documents and no label.  The sets of
rules are nested, so they are tested in a fixed sequence from the loosest on: good
documents of a labelled holdout show how often a set would reject one by mistake, and
an exact binomial test has to rule out that this share is above the limit.  The first
set that fails ends the sequence and the one before it is used, which needs no
correction for the number of steps; the error is divided by the number of strata.
Without proof for the loosest set the stratum has no rules.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.sampling import least_shingle
from larder.llm.tables import labels_of, map_texts, texts
from larder.llm.words import (
    BYTE_CODES, BASE, SPACE, Words, mix, per_text, per_text_bytes, rolled, seeds, windows)
from larder.session import materialise

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SHOUT = np.isin(np.arange(256), list(b"!"))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
TRIPLE = 0x2545F4914F6CDD1D
LONG_TEXT = 200  # words; shorter texts are a stratum of their own
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent

STRATA = ("short", "long")

# Ratios in per cent, and the least spread of each.  A value above the cutoff rejects.
RULES = {
    "symbols": ("try_divide(100D * n_symbols, n_words)", 1.0),
    "shouts": ("try_divide(100D * n_shouts, n_words)", 1.0),
    "capitals": ("try_divide(100D * n_upper, word_chars)", 2.0),
    "lines": ("try_divide(100D * n_dup_lines, n_lines)", 2.0),
    "repeats": ("try_divide(100D * n_repeat_words, n_words)", 2.0),
}
STEPS = (64, 48, 32, 24, 16, 12, 8, 6, 5, 4, 3, 2.5, 2, 1.5, 1)
BIN = 0.25  # ratios are counted by steps of this size for median and spread, up to
MOST = 400.0
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
         "n_shouts", "n_upper")


def line_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one, by text."""
    breaks = np.flatnonzero(words.data == 10)
    start = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, words.offsets[1:]]), kind="stable")
    text = np.repeat(np.arange(words.texts), per_text_bytes(words.data == 10, words) + 1)
    ink = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(~SPACE[words.data], out=ink[1:])
    filled = ink[end] > ink[start]
    start, end, text = start[filled], end[filled], text[filled]
    same = rolled(BYTE_CODES[words.data], start, end, BASE) ^ mix(text.astype(np.uint64))
    first = np.unique(same, return_index=True)[1]
    lines = np.bincount(text, minlength=words.texts)
    return lines, lines - np.bincount(text[first], minlength=words.texts)


def repeated_words(words: Words) -> np.ndarray:
    """Words inside 3-word windows that the text has twice or more, by text."""
    starts = words.window_starts(3)
    same = windows(words.hashes(), starts, 3, TRIPLE) ^ mix(
        words.text[starts].astype(np.uint64) + np.uint64(1))
    inverse, counts = np.unique(same, return_inverse=True, return_counts=True)[1:]
    again = starts[counts[inverse] > 1]
    edges = np.zeros(len(words.start) + 4, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + 3, -1)
    return per_text(np.cumsum(edges)[:len(words.start)] > 0, words)


def _stats(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    data = words.data
    lines, repeated = line_counts(words)
    ink = ~SPACE[data]
    columns = {
        "n_words": words.counts,
        "word_chars": per_text_bytes(ink & ((data & 0xC0) != 0x80), words),
        "n_symbols": per_text_bytes(SYMBOLS[data], words),
        "n_dup_lines": repeated,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        "n_shouts": per_text_bytes(SHOUT[data], words),
        "n_upper": per_text_bytes(UPPER[data], words),
    }
    columns = {k: v.astype(np.int64) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {
        k: pa.array(v) for k, v in columns.items()} | {
        "sketch": pa.array(least_shingle(words).view(np.int64))})


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts ``STATS`` of every text, null counting as empty, and
    ``sketch``, equal for most near copies."""
    return map_texts(texts(docs), _stats, "doc_id long, " + ", ".join(
        f"{c} long" for c in (*STATS, "sketch")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def stratum() -> Column:
    return F.when(F.col("n_words") < LONG_TEXT, "short").otherwise("long")


def at_most(k: int, n: int, p: float) -> float:
    """Probability of ``k`` or fewer of ``n`` at chance ``p`` each.

    The regularised incomplete beta function by its continued fraction.
    """
    if k >= n:
        return 1.0
    a, b, x = float(n - k), k + 1.0, 1.0 - p
    turned = x >= (a + 1) / (a + b + 2)  # where the other tail converges fast
    if turned:
        a, b, x = b, a, p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or 1e-300)
            c = 1.0 + step / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1.0 - front * value if turned else front * value


def spreads(stats: DataFrame) -> dict[tuple[str, str], tuple[float, float]]:
    """Median and spread (quartile distance, or the least) by stratum and rule.

    The driver gets at most ``MOST / BIN`` rows for each.
    """
    binned = F.explode(F.array(*(F.struct(
        F.lit(rule).alias("rule"),
        F.ceil(F.least(F.coalesce(F.expr(ratio), F.lit(0.0)), F.lit(MOST)) / BIN).alias("bin"))
        for rule, (ratio, _) in RULES.items())))
    counts = (stats.where(~base_failed()).select(stratum().alias("stratum"), binned.alias("r"))
              .groupBy("stratum", "r.rule", "r.bin").count().toPandas())
    found = {}
    for key, own in counts.groupby(["stratum", "rule"]):
        own = own.sort_values("bin")
        upto = own["count"].cumsum().to_numpy()
        low, middle, high = (BIN * own["bin"].to_numpy()[np.searchsorted(upto, q * upto[-1])]
                             for q in (0.25, 0.5, 0.75))
        found[key] = (float(middle), max(float(high - low), RULES[key[1]][1]))
    return found


def cutoff_path(spread: dict[tuple[str, str], tuple[float, float]]
                ) -> dict[tuple[str, str], list[float]]:
    """The falling cutoffs of every stratum and rule, one for each of ``STEPS``."""
    return {key: [middle + step * width for step in STEPS]
            for key, (middle, width) in spread.items()}


def first_step(path: dict[tuple[str, str], list[float]]) -> Column:
    """Number of the loosest step that rejects the row; ``len(STEPS)`` for none."""
    def of_rule(where: str, rule: str) -> Column:
        cutoffs = F.array(*map(F.lit, path[where, rule]))
        return F.coalesce(F.size(F.filter(
            cutoffs, lambda c: ~(F.expr(RULES[rule][0]) > c))), F.lit(len(STEPS)))

    value = F.lit(len(STEPS))
    for where in STRATA:
        steps = [of_rule(w, rule) for w, rule in path if w == where]
        if steps:
            value = F.when(stratum() == where, reduce(F.least, steps)).otherwise(value)
    return value


def choose_steps(good: DataFrame, path: dict[tuple[str, str], list[float]], limit: float,
                 error: float) -> dict[str, int]:
    """Number of the tightest proven step by stratum, from statistics of good documents.

    Near copies are one trial, and so are the rows of an id.  The driver gets one row per
    stratum and step.
    """
    trials = good.where(~base_failed()).select(
        "doc_id", "sketch", stratum().alias("stratum"), first_step(path).alias("first"))
    for key in ("doc_id", "sketch"):
        trials = trials.groupBy(key).agg(F.min(F.struct(
            *(c for c in ("doc_id", "sketch", "stratum", "first") if c != key))).alias("one")
        ).select(key, "one.*")
    counts = trials.groupBy("stratum", "first").count().collect()
    chosen = {}
    for where in STRATA:
        own = {r["first"]: r["count"] for r in counts if r["stratum"] == where}
        n, wrong = sum(own.values()), 0
        for step in range(len(STEPS)):
            wrong += own.get(step, 0)
            if not n or at_most(wrong, n, limit) > error / len(STRATA):
                break
            chosen[where] = step
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame, limit: float = 0.02,
                error: float = 0.05) -> DataFrame:
    """Statistics of every document, the rules it breaks and whether it is kept.

    ``docs``: doc_id, text; ``labels``: doc_id, quality.  With probability
    ``1 - error`` the rules reject at most the share ``limit`` of the good
    documents of each stratum (texts below and from ``LONG_TEXT`` words), all rules
    together.  The base rule, under ``MIN_WORDS`` words or over half of them in
    repeated 3-word windows, rejects in any case.  Holdout: documents labelled good
    that pass the base rule, one of each group of near copies.

    Returns one row per row of ``docs``: doc_id, ``STATS``, base_failed, broken
    (names of the rules) and kept.  Null and empty texts have zero words and fail
    the base rule; a null id has no label.  Rows of a repeated id count once in the
    holdout.  Without labels, or too few, no rule is proven and the base
    rule decides alone; of an empty table the result is empty.
    """
    stats = materialise(text_stats(docs), "text-stats")
    good = labels_of(labels, "quality").where("quality = 1")
    path = cutoff_path(spreads(stats))
    chosen = choose_steps(stats.join(good, "doc_id", "left_semi"), path, limit, error)
    broken = [F.when((stratum() == where) & (F.expr(RULES[rule][0]) > cutoffs[chosen[where]]),
                     F.lit(rule))
              for (where, rule), cutoffs in path.items() if where in chosen]
    broken = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return (stats.drop("sketch")
            .withColumn("base_failed", base_failed()).withColumn("broken", broken)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)))
