"""Quality rules with risk-controlled thresholds.

Base features are counted in one pass over whole texts.  Each rule rejects a document whose metric lies above a
cutoff.  The cutoffs are chosen per stratum on labelled documents: going from the loosest to the strictest cutoff
of a fixed grid, a cutoff is accepted while an exact binomial test rejects "more than its share of ``alpha`` of the
good documents fall to this rule"; testing stops at the first that isn't (fixed-sequence testing, so a rule spends its
error once), and the level is divided among all rules and strata (Bonferroni), ``alpha`` among the rules.  With
probability 1 - ``delta``, in all strata the rules together reject at most ``alpha`` of the good documents that pass
the base rules; good documents that fail those are outside the bound.

Counts are summed by stratum, cutoffs are chosen for each stratum where its counts are and joined back to the
documents: strata don't reach the driver, only their number does.

Inputs: a null text has no words (and fails the base rules); very long texts are counted whole; a null stratum is the
stratum ""; a stratum without enough labels rejects nothing; a metric equal to its cutoff isn't above it; labels count
once per id, the highest where rows repeat; null ids have no label; rows that share an id, or are equal, are separate
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

#: Whole of the features, per document.
FEATURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long"

#: Rules: name to the metric in parts per thousand, from the features.
RULES = {
    "symbols": "1000 * n_symbols / greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines / greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words / greatest(n_words, 1)",
    "capitals": "1000 * n_upper / greatest(word_chars, 1)",
}

#: Cutoffs in parts per thousand, from the loosest to the strictest.
GRID = [*range(950, 0, -25), 10, 5, 0]

SPACE = b" \t\n\v\f\r"
CONTINUATION = bytes(range(0x80, 0xC0))
NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
NOT_UPPER = bytes(set(range(256)) - set(range(0x41, 0x5B)))
WINDOW = 5


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words that the text has twice or more."""
    n = len(words)
    if n <= size:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        key = key * np.uint64(common.SpanHashes.BASES[0]) + common.mixed(ids[i : n - size + 1 + i])
    key = common.mixed(key)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return int(common.covered(n, np.flatnonzero(hit), size).sum())


def features_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUATION)),
        len(text.translate(None, NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeat_words(words),
        len(text.translate(None, NOT_UPPER)),
    )


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features_of(text) for text in common.texts(batch)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]],
            names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper"],
        )


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base features of each document."""
    common.tune(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(count, FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def lower_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Bin(n, p), exact up to rounding, in logarithms."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def chosen(n: int, above: list[int], limit: float, level: float) -> int | None:
    """A rule's cutoff, from how many of a stratum's ``n`` good documents lie above each cutoff of the grid."""
    out = None
    for cutoff, k in zip(GRID, above, strict=True):
        if k > n * limit or lower_tail(k, n, limit) > level:
            break
        out = cutoff
    return out


def thresholds(feats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, n (good documents) and the certified cutoff of each rule (null: none), one row per stratum."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    held = feats.join(good.select("doc_id"), "doc_id", "left_semi").where(~base_failed())
    counts = [F.array(*[F.count_if(F.expr(metric) > cutoff) for cutoff in GRID]).alias(rule) for rule, metric in RULES.items()]
    strata = common.written(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts), "strata")
    limit, level = alpha / len(RULES), delta / max(1, strata.count() * len(RULES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cutoffs = [pa.array([chosen(r["n"], r[rule], limit, level) for r in rows], pa.int32()) for rule in RULES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cutoffs], names=["stratum", "n", *RULES])

    return strata.mapInArrow(run, "stratum string, n long, " + ", ".join(f"{rule} int" for rule in RULES))


def verdicts(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Features (a written table) with ``base_failed``, ``rejected_by`` (rules, sorted, comma-joined) and ``kept``."""
    cutoffs = cutoffs.select("stratum", F.struct(*RULES).alias("cut"))
    fired = [F.when(F.expr(RULES[rule]) > F.col("cut")[rule], F.lit(rule)) for rule in sorted(RULES)]
    return (
        common.join_by_key(feats, cutoffs, ["stratum"], "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.concat_ws(",", *fired))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
        .drop("cut")
    )


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: features, base verdict, rules that fired and the final verdict."""
    feats = common.written(features(docs, stratum), "quality-features")
    return verdicts(feats, common.written(thresholds(feats, labels, alpha, delta), "cutoffs"))
