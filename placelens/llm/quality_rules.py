"""Risk-controlled quality rules: cutoffs that falsely reject at most ``alpha`` of the good rows of each stratum.

Every rule is a feature with a fixed grid of cutoffs, from lenient to strict. On labelled holdouts, a cutoff is safe for a
stratum if the exact binomial test refutes "it rejects more than alpha / rules of the good rows" at level
delta / (rules * strata): Bonferroni over rules and strata, so all promises hold at once with probability 1 - delta; within
a grid, cutoffs are tested in their order and testing stops at the first failure, which needs no correction. The
strictest safe cutoff is used; a rule without one (too few labels) rejects nothing in that stratum. As each rule spends
alpha / rules, their union rejects at most alpha.

Defined results: null or empty text has no words and fails the base rule; a null stratum is a stratum of its own; a stratum
without good labels has no safe cutoff, so no rule rejects there; labels that are null or whose id repeats with different
values count as good only if all are good; labels without a row are unused; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sent_if_small, source_key

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Shares in thousandths; a row is rejected if its feature is above (more) or below (less) the cutoff.
RULES = {
    "symbols": ("more", [*range(600, 100, -50), *range(100, 20, -10), *range(20, 0, -2)]),
    "marks": ("more", [*range(2000, 500, -250), *range(500, 100, -50), *range(100, 0, -10)]),
    "capitals": ("more", [*range(1000, 300, -50), *range(300, 100, -20)]),
    "dup_lines": ("more", [*range(1000, 300, -50), *range(300, 0, -20)]),
    "repeats": ("more", [*range(1000, 300, -50), *range(300, 0, -20)]),
    "variety": ("less", [*range(10, 100, 10), *range(100, 700, 25)]),
}
FEATURES = list(RULES)
#: Cutoffs of up to so many strata (a few numbers each) are sent to all tasks; more are joined by a shuffle, which Spark splits at large strata.
SENT_STRATA = 100_000


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the rules' features in thousandths."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        end = 0  # words up to here are counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(i, end)
                end = i + 3
    k = 1000 / max(n, 1)
    return (n, chars, symbols, dup, repeated, int(1000 * symbols / max(chars, 1)), int(k * text.count("!")), int(k * sum(map(bytes.isupper, words))),
            int(1000 * dup / max(len(lines), 1)), int(k * repeated), int(k * len(set(words))))


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row for each row of ``docs``, without its text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]

    def run(batches):
        for b in batches:
            got = np.array([measure(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("stratum"), *(pa.array(got[:, i]) for i in range(len(names)))], names=["doc_id", "stratum", *names])

    return docs.select(F.col("doc_id").cast("long"), source_key(stratum).alias("stratum"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, stratum string, {', '.join(f'{x} long' for x in names)}")


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p): summed from k down, until what is left is below the last bit of the sum."""
    terms, top = [], -math.inf
    for i in range(k, -1, -1):
        terms.append(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        top = max(top, terms[-1])
        if i < n * p and terms[-1] < top - 45:
            break
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def safe_cutoff(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many of the cutoffs, tested in order, are safe; ``rejected``: good rows that each rejects."""
    for i, k in enumerate(rejected):
        if k >= n * alpha or log_binomial_tail(k, n, alpha) > math.log(level):
            return i
    return len(rejected)


def strictness(rule: str):
    """How many cutoffs of the rule, in their order, a feature's value breaks."""
    way, grid = RULES[rule]
    cuts = F.array(*map(F.lit, grid))
    return F.size(F.filter(cuts, lambda c: F.col(rule) > c if way == "more" else F.col(rule) < c))


def calibrate(marked: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum and the number of safe cutoffs of each rule, for every stratum with good rows.

    ``marked``: good holdout rows, written, with columns stratum and, for each rule, how many cutoffs a row breaks. They are
    counted by partial aggregation; what a task tests at once is the histogram of a rule in a stratum.
    """
    strata = marked.select("stratum").distinct().count()
    level = delta / (len(RULES) * max(strata, 1))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("broken")) for r in RULES])).alias("p")
    histograms = marked.select("stratum", each).groupBy("stratum", "p.rule", "p.broken").count()

    def tested(h: pd.DataFrame) -> pd.DataFrame:
        rule = h["rule"].iloc[0]
        counts = np.zeros(len(RULES[rule][1]) + 1, np.int64)
        counts[h["broken"]] = h["count"]
        # Cutoffs run from lenient to strict, so a value that breaks b of them breaks the b strictest.
        rejects = np.cumsum(counts[::-1])[:-1]
        return pd.DataFrame({"stratum": h["stratum"].iloc[:1], "rule": rule, "safe": safe_cutoff(rejects.tolist(), int(counts.sum()), alpha / len(RULES), level)})

    safe = histograms.groupBy("stratum", "rule").applyInPandas(tested, "stratum string, rule string, safe int")
    return safe.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("safe"))).alias(f"safe_{r}") for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and ``broken`` (names of the rules that reject the row)."""
    got = materialise(features(docs, stratum), "quality-features")
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1").select("doc_id")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    got = got.withColumn("base_failed", base_failed)
    marked = got.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi").select("stratum", *[strictness(r).alias(r) for r in RULES])
    limits = materialise(calibrate(materialise(marked, "quality-marks"), alpha, delta), "quality-limits")
    joined = got.join(sent_if_small(limits, SENT_STRATA), "stratum", "left")
    # The first s cutoffs are safe; a value breaks the b strictest of g, so it breaks a safe one if b > g - s.
    hits = [F.when(strictness(r) > len(RULES[r][1]) - F.coalesce(f"safe_{r}", F.lit(0)), F.lit(r)) for r in RULES]
    return joined.withColumn("broken", F.array_compact(F.array(*hits))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken",
    )
