"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue: its documents' tokens in a seeded shuffle. A round adds to the deficit of every queue its share of a
window of ``length`` tokens, by target weight; queues are served in turn, each as many whole quanta of ``quantum`` tokens as
its deficit holds, and what remains of the deficit is carried to the next round, over windows and partitions. An empty queue
is passed over, so the others share its windows by their weights. Deficits start at half a quantum. After ``r`` rounds a queue
of ``u`` quanta and credit ``c`` a round has been served ``min(u, floor(r * c + 1/2))`` of them, so any partition can start
at any round without the ones before it. What is left of each queue below a quantum follows at the end.

Without ``weights`` a source weighs what it has, so that all queues drain together.

Windows are full sequences; the rest at the very end is cut into sequences of powers of two, so nothing is padded.

Defined results: null text is an empty document (only its end id); a null source is a queue of its own (``None`` in
``weights``); sources that ``weights`` do not name weigh 1; repeated rows are packed each; an empty table gives an empty
result; other columns are not read. The driver holds one row a source, tasks their sizes and credits.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, hash_bucket, materialise, running_total, sent_if_small, source_key

SPAN = 24_000_000
#: Parts of a quantum in which deficits are held.
QUANTUM = 1 << 20


class Encoder:
    """Token ids of whole texts as bytes, each with the end id.

    Where neither the pre-tokeniser nor the normaliser joins anything across ASCII blanks and line feeds (it is asked), the
    ids of a text are those of its chunks in order; else whole texts are encoded. Each distinct chunk of a batch is encoded once. Where the vocabulary
    drops case and parts words from punctuation (it is asked), Latin-1 texts are lower-cased and dots and commas
    after a letter cut off before chunks are compared, which gives the same ids from fewer chunks.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        size = max(self.model.get_vocab_size(), end_id + 1)
        self.dtype, self.end = np.dtype("<u2") if size <= 65536 else np.dtype("<u4"), end_id
        one = lambda t: self.model.encode(t, add_special_tokens=False).ids
        self.parts = all(one(t) == [i for w in t.split() for i in one(w)] for t in ("one two", "One, two\nthree  four", " 5 \n\n6. a ", "don't x-y \u00e9t\u00e9 \u6f22 \u5b57"))
        self.folds = one("Word.,") == one("word") + one(".,") and one("\u00c9t\u00e9, a") == one("\u00e9t\u00e9") + one(",") + one("a")
        #: How the pre-tokeniser writes Latin-1 letters; with it, a lower-case word can be handed to the merges alone.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
        self.direct = self.folds and all(self.merged([w])[0] == one(w) for w in ("word", "\u00e9t\u00e9", "stra\u00dfe", "a"))

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.folds:
            plain = pc.invert(pc.match_substring_regex(texts, r"[^\x{00}-\x{ff}]"))
            texts = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([.,]+)([ \n]|$)", r"\1 \2\3"), texts)
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids of lower-case words of Latin-1 letters."""
        tokenize = self.model.model.tokenize
        written = words if all(map(str.isascii, words)) else " ".join(words).translate(self.letters).split(" ")
        return [[t.id for t in tokenize(w)] for w in written]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and where those of each start and how many they are."""
        counts = np.zeros(len(chunks), np.int64)
        plain = np.fromiter((self.direct and c.isalpha() and (c.isascii() or max(c) < "\u0100") and c == c.lower() for c in chunks), bool, len(chunks))
        ascii_ = np.fromiter(map(str.isascii, chunks), bool, len(chunks))
        first, second, other = np.flatnonzero(plain & ascii_), np.flatnonzero(plain & ~ascii_), np.flatnonzero(~plain)
        lists = [ids for group in (first, second) if len(group) for ids in self.merged([chunks[k] for k in group])]
        simple = np.concatenate([first, second])
        counts[simple] = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = [np.fromiter(chain.from_iterable(lists), self.dtype)]
        for part in (other[k : k + 1000] for k in range(0, len(other), 1000)):
            names = [chunks[k] for k in part]
            got = self.model.encode(" ".join(names), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
            counts[part] = np.diff(np.searchsorted(starts, np.cumsum([len(c) + 1 for c in names])), prepend=0)
            ids.append(np.array(got.ids, self.dtype))
        place, order = np.zeros(len(chunks), np.int64), np.concatenate([simple, other])
        place[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(ids), np.stack([place, counts])

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Binary ids of each text."""
        if not self.parts:
            ids = (self.model.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist())
            return pa.array([np.array([*i, self.end], self.dtype).tobytes() for i in ids], pa.binary())
        lists = self.chunks(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        flat, (place, counts) = self.encode(words.dictionary.to_pylist())
        index = words.indices.to_numpy(zero_copy_only=False)
        n, first = counts[index], place[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if ends[-1] + len(lists) + len(flat) < 2**31 else np.int64
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets -= offsets[0]
        along = np.arange(ends[-1], dtype=kind)
        take = along + np.repeat((first - ends[:-1]).astype(kind), n)
        stops = ends[offsets]  # where texts begin and end among the tokens
        doc = np.repeat(np.arange(len(lists), dtype=kind), np.diff(stops))
        out = np.full(ends[-1] + len(lists), self.end, self.dtype)
        out[along + doc] = flat[take]
        size = self.dtype.itemsize
        edges = ((stops + np.arange(len(stops))) * size).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edges), pa.py_buffer(out)])


_encoders: dict[tuple[str, int], Encoder] = {}


def shared_encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def spans(batch: pa.RecordBatch, column: str) -> list[pa.RecordBatch]:
    """The batch in slices of about ``SPAN`` bytes of a text column, a longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(SPAN, (sizes[-1] if len(sizes) else 0) + SPAN, SPAN)), batch.num_rows))
    edges = np.unique(np.concatenate([[0], cuts])).tolist()
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:])]


def credits_of(weights: list[float], quanta: int) -> np.ndarray:
    """What a round of so many quanta adds to the deficit of each queue, in parts of a quantum."""
    w = np.array(weights, float)
    return np.maximum(np.rint(w / max(w.sum(), 1e-300) * quanta * QUANTUM), 1).astype(np.int64)


def slots_of(queue: np.ndarray, k: np.ndarray, units: np.ndarray, credits: np.ndarray) -> np.ndarray:
    """The place among all quanta of the k-th quantum of a queue; ``units``: quanta of each queue."""
    half = QUANTUM // 2
    last = -(-units * QUANTUM // credits)  # rounds after which a queue is empty
    turn = -(-((k + 1) * QUANTUM - half) // credits[queue])  # the round that serves it
    out, every = k.copy(), np.arange(len(units))
    step = max(1, (1 << 20) // max(len(units), 1))
    for at in (slice(i, i + step) for i in range(0, len(k), step)):
        rounds = turn[at, None] - (every >= queue[at, None])  # later queues have not been served in this round
        others = np.minimum(units, (np.minimum(rounds, last) * credits + half) // QUANTUM)
        others[np.arange(len(others)), queue[at]] = 0
        out[at] += others.sum(axis=1)
    return out


def rest(total: int, length: int) -> list[int]:
    """Where sequences start, and the end, from the last full window on."""
    at = total // length * length
    edges, left = [at], total - at
    while left:
        edges.append(edges[-1] + (1 << (left.bit_length() - 1)))
        left -= edges[-1] - edges[-2]
    return edges


def cut(queue: np.ndarray, pos: np.ndarray, n: np.ndarray, credits: np.ndarray, units: np.ndarray, tails: np.ndarray, quantum: int, length: int, edges: list[int]) -> np.ndarray:
    """Pieces of documents that hold tokens pos to pos + n of their queues: rows of document, start, length, sequence, offset."""
    whole = units[queue] * quantum  # a queue's tokens in full quanta
    first = pos // quantum
    many = np.maximum(np.minimum((pos + n - 1) // quantum, units[queue] - 1) - first + 1, 0)
    doc = np.repeat(np.arange(len(pos)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    lo, hi = np.maximum(k * quantum, pos[doc]), np.minimum((k + 1) * quantum, (pos + n)[doc])
    at = lo - k * quantum + slots_of(queue[doc], k, units, credits) * quantum
    over = np.flatnonzero(pos + n > whole)  # what is left of a queue below a quantum
    start = np.maximum(pos, whole)[over]
    doc, lo, hi, at = (np.concatenate(x) for x in ((doc, over), (lo, start), (hi, (pos + n)[over]), (at, tails[queue][over] + start - whole[over])))
    order = np.lexsort((lo, doc))
    doc, lo, hi, at = doc[order], lo[order], hi[order], at[order]
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1]) | (at[1:] % length == 0)
    starts = np.flatnonzero(begins)
    doc, lo, hi, at = doc[starts], lo[starts], hi[np.append(starts[1:], len(doc))[: len(starts)] - 1], at[starts]
    size, lo = hi - lo, lo - pos[doc]
    plain = (at + size <= edges[0]) & (at % length + size <= length)
    out = [np.stack([doc, lo, size, at // length, at % length], axis=1)[plain]]
    for d, s, m, g in zip(*(x[~plain].tolist() for x in (doc, lo, size, at)), strict=True):
        rows = []
        while m:  # a remainder can straddle windows, and the last window is cut into powers of two
            if g < edges[0]:
                seq, off, room = g // length, g % length, length - g % length
            else:
                i = next(j for j in range(len(edges) - 1) if g < edges[j + 1])
                seq, off, room = edges[0] // length + i, g - edges[i], edges[i + 1] - g
            take = min(m, room)
            rows.append((d, s, take, seq, off))
            s, g, m = s + take, g + take, m - take
        out.append(np.array(rows, np.int64))
    return np.concatenate(out)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, quantum: int = 128, end_id: int = 2, seed: int = 5, weights: dict[str | None, float] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source: one row for each piece of a document."""
    if length % quantum:
        raise ValueError("length must be a multiple of quantum")
    if weights is not None and min(weights.values(), default=1) <= 0:
        raise ValueError("weights must be over 0")
    spark = docs.sparkSession

    def encode(batches):
        coder = shared_encoder(tokenizer, end_id)
        for b in (part for whole in batches for part in spans(whole, "text")):
            ids = coder(b.column("text"))
            n = pc.cast(pc.divide(pc.binary_length(ids), coder.dtype.itemsize), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "source", "order")), n, ids], names=["row", "doc_id", "source", "order", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"), F.col("text").cast("string"))
    tokens = materialise(rows.mapInArrow(encode, "row long, doc_id long, source string, order long, n long, ids binary"), "pack-tokens")

    totals = tokens.groupBy(source_key().alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.first("source").alias("source")).orderBy(F.desc("n"), "key").collect()
    sizes = [r["n"] for r in totals]
    credits = credits_of([r["n"] if weights is None else weights.get(r["source"], 1) for r in totals], length // quantum)
    names = sent_if_small(spark.createDataFrame([(r["key"], i) for i, r in enumerate(totals)], "key string, queue int"))
    narrow = tokens.select("row", "n", "order", source_key().alias("key")).join(names, "key").drop("key")
    placed = running_total(narrow, ["queue"], hash_bucket("order", buckets_for(sum(r["rows"] for r in totals))), ["order", "row"], "n", "pos").select("row", "queue", "pos")

    sizes = np.array(sizes, np.int64)
    units = sizes // quantum
    tails = np.concatenate([[0], np.cumsum(sizes % quantum)]) + units.sum() * quantum
    edges = rest(int(sizes.sum()), length)
    itemsize = shared_encoder(tokenizer, end_id).dtype.itemsize

    def split(batches):
        for b in batches:
            queue, pos, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "pos", "n"))
            pieces = cut(queue, pos, n, credits, units, tails, quantum, length, edges)
            ids = pa.concat_arrays([b.column("ids")])
            bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // itemsize
            data = memoryview(np.frombuffer(ids.buffers()[2] or b"", f"<u{itemsize}").astype("<u4").tobytes())
            doc = pieces[:, 0]
            begin = 4 * (bounds[doc] + pieces[:, 1])
            crc = [zlib.crc32(data[a:z]) for a, z in zip(begin.tolist(), (begin + 4 * pieces[:, 2]).tolist(), strict=True)]
            index = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(index), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(pieces[:, 3]), pa.array(pieces[:, 4]), b.column("source").take(index)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return tokens.select("row", "doc_id", "source", "n", "ids").join(placed, "row").mapInArrow(split, schema)

