"""Cross-entropy difference: how much likelier a target language model finds a document than a background model.

Both models are interpolated word bigram models over one vocabulary, every word of the corpus, with every pair that
occurs. Background counts cover all documents, target counts all documents labelled as good. Both take one absolute
``discount`` from each pair they have seen and give it to their word distribution. A larger sample has seen more, so the
background is matched to the target's size: it is the expected model of a random sample of its tokens, as many as the
target has. With the share r of tokens kept, a pair counted c times is expected r * c times and is seen with probability
1 - (1 - r) ** c. A document's score is the mean over its tokens of target loss minus background loss, in nats: lower is
closer to the target.

Each document is scored by the models of all others: what it has counted itself is taken off before (cross-fitting, a fold
a document). So labelled good documents score like good ones without a label.

The model is never in one place. Texts are cut into chunks of about ``chunk`` tokens, written as numbers with the 64-bit
hashes of their words (a billion different pairs hold one collision with a chance of 3 %). Each chunk sends its
distinct pairs, then its distinct words, to the buckets of their hashes, where they are summed over all chunks, and gets
the sums back; so what is counted and moved grows with the input, and a frequent pair is one entry a chunk.

Defined results: null and empty text has no tokens, losses and score 0; ids that repeat in ``labels`` are good only if all
are; repeated rows count each; without good documents the models are equal and all scores 0; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sent_if_small


class Local(dict):
    """Word to number in order of first sight; 0 is the start of a text, which no word can equal."""

    def __init__(self):
        super().__init__({" ": 0})

    def __missing__(self, word: str) -> int:
        self[word] = got = len(self)
        return got


def packed(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second and so on: most of these runs are nearly constant."""
    places = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T
    return pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    places = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(places.T).reshape(-1).view(dtype)


CHUNK = "chunk long, doc_ids array<long>, lengths binary, good binary, tokens binary, words binary, n long, n_good long"
PART = "chunk long, bucket int, key binary, n binary"
SUMS = "chunk long, bucket int, n binary, owned long"


def chunks_of(docs: DataFrame, chunk: int) -> DataFrame:
    """docs: doc_id, text and good. One row for each run of documents with about ``chunk`` tokens."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        local, ids, good, held, many = Local(), [], [], [], 0

        def out():
            lengths = np.array([len(x) for x in held], np.int32)
            marks = np.array(good, bool)
            words = pd.util.hash_array(np.array(list(local), object), categorize=False)
            row = [[at], [ids], [lengths.tobytes()], [marks.tobytes()], [packed(np.concatenate(held))], [words.tobytes()], [int(lengths.sum())], [int(lengths[marks].sum())]]
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["chunk", "doc_ids", "lengths", "good", "tokens", "words", "n", "n_good"])

        for b in batches:
            for i, t, g in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("good").to_pylist(), strict=True):
                x = np.array(list(map(local.__getitem__, (t.as_py() or "").split())), np.int32)
                ids.append(i)
                good.append(g)
                held.append(x)
                many += len(x) + 1
                if many >= chunk:
                    yield out()
                    at += 1
                    local, ids, good, held, many = Local(), [], [], [], 0
        if ids:
            yield out()

    return docs.select("doc_id", "text", "good").mapInArrow(run, CHUNK)


class Chunk:
    """A row of ``chunks_of``: its distinct pairs (``first``, ``second``), the pair ``of`` each token, and counts of all and good."""

    def __init__(self, row: dict):
        self.row = row
        self.words, self.lengths = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["lengths"], np.int32)
        self.tokens = unpacked(row["tokens"], np.int32, row["n"])
        self.marks = np.repeat(np.frombuffer(row["good"], bool), self.lengths)
        self.before = np.concatenate([[0], self.tokens[:-1]])[: len(self.tokens)].astype(np.int64)
        self.before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = 0
        both, self.of, self.n = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True, return_counts=True)
        self.first, self.second = both // len(self.words), both % len(self.words)
        self.n_good = np.bincount(self.of, weights=self.marks, minlength=len(both))

    def keys(self) -> np.ndarray:
        x = self.words[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.second]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def order_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, and the order by buckets."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    return bucket, np.argsort(bucket, kind="stable")


def parts(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, dtype=np.int32) -> pa.RecordBatch:
    """Rows of PART, in the order of ``order_of``."""
    bucket, order = order_of(keys, buckets)
    names, starts = np.unique(bucket[order], return_index=True)
    cuts = np.split(order, starts[1:]) if len(names) else []
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.array([keys[c].tobytes() for c in cuts], pa.binary()), pa.array([packed(counts[:, c].astype(dtype)) for c in cuts], pa.binary())], names=["chunk", "bucket", "key", "n"]
    )


def sums(rows: DataFrame, columns: int, dtype=np.int32) -> DataFrame:
    """The counts of PART rows summed over all chunks (doubles), for each key in the chunk's order; then whether this chunk owns the key."""

    def merge(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("key")]
        ends = np.cumsum([len(k) for k in keys])
        counts = np.concatenate([unpacked(n.as_py(), dtype, columns * len(k)).reshape(columns, -1) for n, k in zip(table.column("n"), keys, strict=True)], axis=1)
        both, at, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.stack([*(np.bincount(of, weights=c, minlength=len(both))[of] for c in counts), np.zeros(len(of))])
        total[-1, at] = 1
        pieces = np.split(total, ends[:-1], axis=1)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array([packed(p) for p in pieces], pa.binary()), "owned": pa.array([int(p[-1].sum()) for p in pieces], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(merge, SUMS)


def placed(table: pa.Table, keys: np.ndarray, columns: int, buckets: int) -> np.ndarray:
    """SUMS rows of one chunk as an array of columns + 1 by keys."""
    bucket, order = order_of(keys, buckets)
    size = np.bincount(bucket, minlength=buckets)
    got = sorted(zip(table.column("bucket").to_pylist(), table.column("n"), strict=True), key=lambda r: r[0])
    out = np.zeros((columns + 1, len(keys)))
    if got:
        out[:, order] = np.concatenate([unpacked(n.as_py(), np.float64, (columns + 1) * size[b]).reshape(columns + 1, -1) for b, n in got], axis=1)
    return out


def seen(count: np.ndarray, kept: float) -> np.ndarray:
    """The chance that a pair counted so often is in a sample that keeps the share ``kept`` of tokens.

    To 32 binary places, so that sums are exact and the order of chunks does not matter.
    """
    return np.round((1 - (1 - kept) ** count) * 2.0**32) / 2.0**32


class Own:
    """What each document of a chunk has counted itself, for each of its distinct pairs: ``n`` of the pair, of its first and second word."""

    def __init__(self, c: Chunk):
        doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
        both, self.n = np.unique(doc * max(len(c.n), 1) + c.of, return_counts=True)
        self.doc, self.pair = both // max(len(c.n), 1), both % max(len(c.n), 1)
        _, self.by_first = np.unique(self.doc * len(c.words) + c.first[self.pair], return_inverse=True)
        _, by_second = np.unique(self.doc * len(c.words) + c.second[self.pair], return_inverse=True)
        self.first = np.bincount(self.by_first, weights=self.n)[self.by_first] if len(both) else self.n
        self.second = np.bincount(by_second, weights=self.n)[by_second] if len(both) else self.n

    def kinds(self, pair: np.ndarray, kept: float) -> np.ndarray:
        """How many of the pairs seen with a first word are seen no more without this document."""
        return np.bincount(self.by_first, weights=seen(pair, kept) - seen(np.maximum(pair - self.n, 0), kept))[self.by_first] if len(self.n) else self.n


def loss(pair, first, kinds, second, mass, kept: float, known: int, discount: float, floor: float = 0.5) -> np.ndarray:
    """- log P(second | first): absolute discounting over the word distribution, of a sample that keeps the share ``kept`` of
    tokens; ``kinds``: pairs expected with that first word, ``known``: words of the vocabulary."""
    word = (kept * second + floor) / (kept * mass + floor * known)
    held = (kept * pair - discount * seen(pair, kept) + discount * kinds * word) / (kept * np.maximum(first, 1))
    return -np.log(np.where(first > 0, held, word))


def losses(docs: DataFrame, chunk: int, bucket_tokens: int, discount: float) -> DataFrame:
    """docs: doc_id, text and good. The scores under models of all words and pairs."""
    chunks = materialise(chunks_of(docs, chunk), "lm-chunks")
    n, n_good = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    buckets = max(64, n // bucket_tokens)

    def pair_parts(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                yield parts(row["chunk"], c.keys(), np.stack([c.n, c.n_good]), buckets)

    pairs = materialise(sums(chunks.mapInArrow(pair_parts, PART), 2), "lm-pairs")

    kept = n_good / n if n_good else 1.0

    def word_parts(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            c = Chunk(row)
            pair, good, own = placed(right, c.keys(), 2, buckets)
            first, first_good, kinds, kinds_good = (np.bincount(c.first, weights=w, minlength=len(c.words)) for w in (c.n, c.n_good, own * seen(pair, kept), own * (good > 0)))
            second, second_good = (np.bincount(c.second, weights=w, minlength=len(c.words)) for w in (c.n, c.n_good))
            # A word is followed by another but at the end of a text, and most pairs of a rare word differ: these are small numbers.
            out.append(parts(row["chunk"], c.words, np.stack([second - first, second_good - first_good, kinds, first_good - kinds_good, second, second_good]), buckets, np.float64))
        return pa.Table.from_batches(out)

    words = materialise(sums(chunks.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(word_parts, PART), 6, np.float64), "lm-words")
    known = max(words.agg(F.coalesce(F.sum("owned"), F.lit(0))).first()[0], 1)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            c, kind = Chunk(row), right.column("kind").to_numpy(zero_copy_only=False)
            own, marked = Own(c), np.frombuffer(row["good"], bool)
            pair, good, _ = placed(right.filter(pa.array(kind == 0)), c.keys(), 2, buckets)[:, own.pair]
            words = placed(right.filter(pa.array(kind == 1)), c.words, 6, buckets)
            followed, followed_good = words[4] - words[0], words[5] - words[1]
            first, first_good, kinds, kinds_good = (x[c.first[own.pair]] for x in (followed, followed_good, words[2], followed_good - words[3]))
            second, second_good = words[4:6, c.second[own.pair]]
            size = c.lengths.astype(np.int64)
            z = loss(pair - own.n, first - own.first, kinds - own.kinds(pair, kept), second - own.second, n - size[own.doc], kept, known, discount)
            if n_good:
                mine = marked[own.doc]  # a document without the label has counted nothing in the target
                a = loss(good - mine * own.n, first_good - mine * own.first, kinds_good - mine * own.kinds(good, 1.0), second_good - mine * own.second, n_good - mine * size[own.doc], 1.0, known, discount)
            else:
                a = z
            a, z = (np.bincount(own.doc, weights=x * own.n, minlength=len(size)) / np.maximum(size, 1) for x in (a, z))
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(size), "loss_target": pa.array(a), "loss_background": pa.array(z), "score": pa.array(a - z)}))
        return pa.concat_tables(out)

    back = pairs.select("chunk", F.lit(0).alias("kind"), "bucket", "n").union(words.select("chunk", F.lit(1).alias("kind"), "bucket", "n"))
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scores, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, discount: float = 0.75, chunk: int = 1_000_000, bucket_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (nats a token) and score of every row of ``docs``."""
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1").select("__id", F.lit(True).alias("good"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return losses(with_good(ids, good), chunk, bucket_tokens, discount)


def with_good(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Texts marked by a join on ids; texts are shuffled only where the ids are too many to be sent to all tasks."""
    good = sent_if_small(materialise(good, "lm-good"))
    return docs.join(good, docs["doc_id"] == good["__id"], "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
