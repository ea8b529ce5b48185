"""Class-conditional Kneser-Ney models of toxic and ordinary text.

Each class has an interpolated bigram model with absolute discounting; what discounting frees goes to the class's word
distribution, and what that frees to continuation counts shared by both classes (in how many contexts of either class a word
was seen). Backing off is shared: every pair, and every word, that either class has seen is lent ``lent`` sightings, and
discounted once, divided between the classes in proportion to their sizes. So both classes know the same expressions; one
that was seen once, in whichever class, has nearly the same probability in both, and one that a class has seen often keeps its
weight. Every word and pair of the learnt rows counts, however rare. Words that no learnt row holds share a reserved mass, the
same in both classes, so they tell nothing.

The evidence of a word is the ratio P(word | previous, toxic) / P(word | previous, ordinary). A document has the mean of the log
ratio, which is the difference of the length-normalised log-likelihoods, and ``peak``, the log of the mean ratio, which is not
drowned where few of many words are toxic. A logistic curve of both and the length, fitted on a fold that the counts have
not seen, makes them a score.

Learns from at most about ``max_rows`` labelled rows and ``max_bytes`` of their text (a seeded hash of the text picks them);
those bounds are the parameters of the classifier's sample, and bound the model: a word gives one pair at most. Words are known by
64-bit hashes. Counts and ratios are computed by Spark; the driver receives sorted hashes and their ratios.

Defined results: null and empty text scores what no evidence scores; a null id is neither learnt from nor held out; ids
that repeat in labels with different values are toxic; repeated rows are rows of their own; where the labels lack a
class, every score is that of the other class (0.27 or 0.73); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sent_if_small
from .ngram_join import PRIME, mix

_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The word before the first.
START = np.uint64(1)
DISCOUNT = 0.75
FLUSH = 4_000_000
#: Rows of a word table that are sent to all tasks; beyond, pairs meet it by a shuffle.
SENT_WORDS = 500_000


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()], np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * PRIME + second)


def before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], x[:-1]]).astype(np.uint64)[: len(x)]


def pair_counts(rows: DataFrame) -> DataFrame:
    """key, first, second, n0, n1: occurrences of each pair of neighbouring words in ordinary and in toxic rows."""

    def run(batches):
        held, many = [], 0

        def out():
            first, second, toxic = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.uint64)]) for k in range(3))
            key, at, own = np.unique(pair_keys(first, second), return_index=True, return_inverse=True)
            n = [np.bincount(own[toxic == y], minlength=len(key)) for y in (0, 1)]
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, first[at], second[at])), *(pa.array(x.astype(np.int64)) for x in n)], names=["key", "first", "second", "n0", "n1"])

        for b in batches:
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                x = words(t.as_py())
                held.append((before(x), x, np.full(len(x), y, np.uint64)))
                many += len(x)
                if many > FLUSH:
                    yield out()
                    held, many = [], 0
        yield out()

    return rows.mapInArrow(run, "key long, first long, second long, n0 long, n1 long").groupBy("key", "first", "second").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def models(pairs: DataFrame, lent: float) -> tuple[DataFrame, DataFrame]:
    """(word, and logs toxic / ordinary: ratio of its probability, back of what backing off from it gives; key, and ratio of each pair)."""
    seconds = pairs.groupBy(F.col("second").alias("word")).agg(*[F.sum(f"n{y}").alias(f"c{y}") for y in (0, 1)], F.sum((F.col("n0") > 0).cast("long") + (F.col("n1") > 0).cast("long")).alias("contexts"))
    seconds = materialise(seconds, "toxic-words")
    facts = seconds.agg(F.count("*").alias("words"), F.sum("contexts").alias("contexts"), *[F.sum(f"c{y}").alias(f"c{y}") for y in (0, 1)]).first()
    total = [float(facts[f"c{y}"] or 0) for y in (0, 1)]
    part = [t / max(sum(total), 1.0) for t in total]  # a class's part of what is lent and discounted
    shared = F.col("contexts") / float(max(facts["contexts"] or 0, 1))

    def probability(seen: str, kinds, base, y: int):
        """``seen`` sightings of ``total`` in a context of so many kinds of pairs, interpolated with ``base``."""
        if not part[y]:
            return base  # a class without rows follows what is shared
        return (F.col(seen) + (lent - DISCOUNT) * part[y] + DISCOUNT * part[y] * kinds * base)

    own = [probability(f"c{y}", float(facts["words"]), shared, y) / (total[y] + lent * part[y] * facts["words"]) if part[y] else shared for y in (0, 1)]
    known = seconds.select("word", own[0].alias("u0"), own[1].alias("u1"))
    totals = pairs.groupBy("first").agg(*[F.sum(f"n{y}").alias(f"t{y}") for y in (0, 1)], F.count("*").alias("kinds"))
    full = [F.col(f"t{y}") + lent * part[y] * F.col("kinds") for y in (0, 1)]
    firsts = totals.select("first", "kinds", *[f.alias(f"t{y}") for y, f in enumerate(full)])
    firsts = materialise(firsts, "toxic-firsts")
    met = pairs.join(sent_if_small(firsts, SENT_WORDS), "first").join(sent_if_small(known.withColumnRenamed("word", "second"), SENT_WORDS), "second")
    log = [F.log(probability(f"n{y}", F.col("kinds"), F.col(f"u{y}"), y) / F.col(f"t{y}") if part[y] else F.col(f"u{y}")) for y in (0, 1)]
    freed = [F.log(DISCOUNT * part[y] * F.col("kinds") / F.col(f"t{y}")) if part[y] else F.lit(0.0) for y in (0, 1)]
    backs = firsts.select(F.col("first").alias("word"), (freed[1] - freed[0]).alias("back"))
    one = known.select("word", F.log(F.col("u1") / F.col("u0")).alias("ratio")).join(backs, "word", "full").select("word", *[F.coalesce(c, F.lit(0.0)).cast("float").alias(c) for c in ("ratio", "back")])
    return one, met.select("key", (log[1] - log[0]).cast("float").alias("pair"))


def sorted_columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table, in the order of the first, which is read as unsigned."""
    table = df.toArrow()
    first, *others = (c.to_numpy() for c in table.columns)
    first = first.view(np.uint64)
    order = np.argsort(first)
    return [x[order] for x in (first, *others)]


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: np.ndarray | float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked)) + other
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other)


def evidence(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the mean likelihood ratio of a word, mean log ratio, and number of words of each text; 0 without words."""
    own = [words(t) for t in texts]
    n = np.array([len(x) for x in own], np.int64)
    peak, mean, some = np.zeros(len(n)), np.zeros(len(n)), n > 0
    if some.any():
        first, second = np.concatenate([before(x) for x in own]), np.concatenate(own)
        alone = looked_up(model["word"], model["back"], first) + looked_up(model["word"], model["ratio"], second)
        ratio = looked_up(model["key"], model["pair"], pair_keys(first, second), alone).astype(np.float64)
        starts = (np.cumsum(n) - n)[some]
        mean[some] = np.add.reduceat(ratio, starts) / n[some]
        peak[some] = np.log(np.add.reduceat(np.exp(ratio), starts) / n[some])
    return peak, mean, n


def inputs(peak: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Both normalised by length; the length itself, as a few toxic words weigh less in a long text; a constant."""
    return np.stack([peak, mean, np.log(n + 1.0), np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


def train(rows: DataFrame, lent: float) -> dict:
    """rows: text, toxic (0 or 1) and calibrate (rows for the curve, not for the counts)."""
    one, two = models(materialise(pair_counts(rows.filter(~F.col("calibrate")).select("text", "toxic")), "toxic-pairs"), lent)
    model = dict(zip(one.columns, sorted_columns(one), strict=True)) | dict(zip(two.columns, sorted_columns(two), strict=True))
    model["curve"] = np.array([0.0, 0.0, 0.0, -1.0])
    held = score_raw(rows.filter("calibrate").select("text", "toxic"), model, ("toxic",)).toPandas()
    y = held["toxic"].to_numpy(np.float64)
    if len(y) and 0 < y.sum() < len(y):
        model["curve"] = logistic(inputs(held["peak"].to_numpy(), held["mean"].to_numpy(), held["n"].to_numpy()), y)
    elif len(y) and y.sum():
        model["curve"] = np.array([0.0, 0.0, 0.0, 1.0])
    return model


def score_raw(docs: DataFrame, model: dict, keep: tuple[str, ...]) -> DataFrame:
    """keep, peak, mean and n of each row."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            got = evidence(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(g) for g in got)], names=[*keep, "peak", "mean", "n"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "peak double, mean double, n long"]))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 120_000, max_bytes: int = 3 << 23, lent: float = 2.0, seed: int = 13) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, peak and mean (the evidence) of every row of ``docs``."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold.alias("fold"))
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    learn = materialise(marks.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held), "toxic-labels")
    place = F.xxhash64(F.lit(seed), "text").cast("double") / F.lit(2.0**64) + 0.5
    known = docs.filter((F.col("fold") != held) & F.col("text").isNotNull()).join(sent_if_small(learn), "doc_id")
    facts = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    rate = min(1.0, max_rows / max(facts["n"], 1), max_bytes / max(facts["bytes"] or 0, 1))
    rows = known.filter(place < rate).select("text", "toxic", (F.col("fold") == (held + folds - 1) % folds).alias("calibrate"))
    model = train(materialise(rows, "toxic-rows"), lent)
    curve = model["curve"]
    got = score_raw(docs.withColumn("held_out", F.coalesce(F.col("fold") == held, F.lit(False))), model, ("doc_id", "held_out"))
    z = float(curve[0]) * F.col("peak") + float(curve[1]) * F.col("mean") + float(curve[2]) * F.log(F.col("n") + 1.0) + float(curve[3])
    scored = got.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("n").alias("n_words"), "peak", "mean")
