"""Alignment of two tokenizers' tokens through a dictionary of groups.

A text is encoded by tokenizer A (byte-level BPE, with a blank put before the text) and by tokenizer B (SentencePiece, which adds
that blank itself). Where tokens of both end at the same byte, the tokens are cut into groups. Groups repeat far more often than
they differ, so a block of documents (``block_bytes`` of text, within a task) interns its distinct groups, each a sequence of A
ids and one of B ids, and its documents hold numbers of the dictionary. The links of a group, the pairs of an A and a B token
whose bytes overlap, are expanded once for each distinct group of a block, to count the distinct documents of each id pair, and
once for each distinct group of all blocks, to sum what its links count; sums come back to blocks by the group and to documents
by the group's number in their block.

The tables that travel have a row for each distinct group or pair of a block, never for each token or link. Pairs with counts go to
all tasks up to ``most_pairs``, and meet the links by a shuffle beyond.

Defined results: texts that are null or empty, or whose joined token bytes differ from blank + text (B replaces some characters),
have no tokens: zeros, and '' for the digest. Strings of special tokens in a text are plain text. Repeated rows and null ids are
documents of their own; ties for the highest count of an A id are all highest; an empty table gives an empty result; other
columns are not read. A text is encoded whole, in memory that grows with its length.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Stands between the A and the B ids of a group; no id has this value.
BETWEEN = np.int32(-1).tobytes()
#: How the byte-level tokenizer cuts text before merging: a fixed value of its format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PARTS = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<int>, times array<int>, gid int, key binary, a int, b int, docs long"


def byte_letters() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: its own, or the next free one from U+0100."""
    plain = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c]
    others = [c for c in range(256) if c not in plain]
    return {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(others)}


class Pair:
    """Both tokenizers: ids of texts, and the bytes of ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, special = byte_letters(), {}
        vocabulary = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        first = len(model["vocab"]) - len(merged)
        if len(vocabulary) == len(model["vocab"]) and all(bytes([c]) in vocabulary for c in range(256)) and all(model["vocab"][m] == first + i for i, m in enumerate(merged)):
            import tiktoken  # ids are ranks of merges: the same ids, several times faster

            own = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=vocabulary, special_tokens=special)
            self.encode_a = lambda texts: [own.encode_to_numpy(t, disallowed_special=()) for t in texts]
            self.lossless = True  # every byte is in the vocabulary, so the joined bytes are the text's
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(a_path)
            own.encode_special_tokens = True
            self.encode_a = lambda texts: [own.encode(t, add_special_tokens=False).ids for t in texts]
            self.lossless = False
        self.a_bytes = {i: token for token, i in vocabulary.items()}
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = lambda texts: pieces.encode(texts, num_threads=1)
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in range(pieces.get_piece_size()) for p in [pieces.id_to_piece(i)]}
        self.a_sizes, self.b_sizes = sizes(self.a_bytes), sizes(self.b_bytes)
        self.a_size, self.b_size = self.a_sizes.tolist(), self.b_sizes.tolist()

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A ids and B ids of each text; none where the joined bytes are not blank + text."""
        for text, a, b in zip(texts, self.encode_a([" " + t for t in texts]), self.encode_b(texts), strict=True):
            whole = (" " + text).encode("utf-8", "surrogatepass")
            same = text != "" and b"".join(map(self.b_bytes.__getitem__, b)) == whole and (self.lossless or b"".join(map(self.a_bytes.__getitem__, a)) == whole)
            yield (np.array(a, np.int32), np.array(b, np.int32)) if same else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def sizes(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens, default=0) + 1, np.int64)
    for i, t in tokens.items():
        out[i] = len(t)
    return out


@functools.lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def group_links(key: bytes, pair: Pair) -> tuple[list[int], list[int]]:
    """A ids and B ids of the links of a group: of two tokens that overlap, the one that ends first gives way to the next."""
    ids = np.frombuffer(key, np.int32).tolist()
    cut = ids.index(-1)
    a, b = ids[:cut], ids[cut + 1 :]
    i = j = 0
    left = pair.a_size[a[0]] - pair.b_size[b[0]]  # by how much the A token ends behind the B token
    x, y = [a[0]], [b[0]]
    while i + 1 < len(a) or j + 1 < len(b):
        if left < 0:
            i += 1
            left += pair.a_size[a[i]]
        else:  # never 0 before the group's end
            j += 1
            left -= pair.b_size[b[j]]
        x.append(a[i])
        y.append(b[j])
    return x, y


def links(keys: list[bytes], pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups' numbers (rising), A ids and B ids of all links of groups."""
    one = np.array([len(k) == 12 for k in keys], bool)
    single = np.frombuffer(b"".join([k for k in keys if len(k) == 12]), np.int32).reshape(-1, 3)
    owner, x, y = [], [], []
    for g in np.flatnonzero(~one).tolist():
        a, b = group_links(keys[g], pair)
        owner += [g] * len(a)
        x += a
        y += b
    owner = np.concatenate([np.flatnonzero(one), np.array(owner, np.int64)])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([single[:, 0], np.array(x, np.int32)])[order], np.concatenate([single[:, 2], np.array(y, np.int32)])[order]


class Dictionary:
    """The distinct groups of a block, and its documents in their numbers.

    A group has a code: both ids if it is one token on each side, as most are, else a negative number of its own.
    """

    def __init__(self, pair: Pair):
        self.pair, self.keys, self.number, self.shown, self.longer, self.docs, self.bytes = pair, [], {}, {}, {}, [], 0

    def meet(self, code: int, key: bytes) -> None:
        self.number[code] = len(self.keys)
        self.keys.append(key)
        ids = np.frombuffer(key, np.int32).tolist()
        cut = ids.index(-1)
        self.shown[code] = ",".join(map(str, ids[:cut])) + "|" + ",".join(map(str, ids[cut + 1 :]))

    def add(self, doc_id, text: str | None, a: np.ndarray, b: np.ndarray) -> None:
        self.bytes += len(text or "")
        if not len(a):
            self.docs.append((doc_id, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            return
        ea, eb = np.cumsum(self.pair.a_sizes[a]), np.cumsum(self.pair.b_sizes[b])
        at = np.zeros(ea[-1] + 1, np.int8)
        at[ea] += 1
        at[eb] += 1
        last = [np.flatnonzero(at[e] == 2) for e in (ea, eb)]
        first = [np.concatenate([[0], e[:-1] + 1]) for e in last]
        codes = a[last[0]].astype(np.int64) << 32 | b[last[1]]
        several = np.flatnonzero((first[0] != last[0]) | (first[1] != last[1]))
        if len(several):
            raw_a, raw_b, longer, own = a.tobytes(), b.tobytes(), self.longer, []
            for s, e, u, v in zip(*((4 * x[several]).tolist() for x in (first[0], last[0] + 1, first[1], last[1] + 1)), strict=True):
                key = raw_a[s:e] + BETWEEN + raw_b[u:v]
                code = longer.get(key)
                if code is None:
                    code = longer[key] = -1 - len(longer)
                    self.meet(code, key)
                own.append(code)
            codes[several] = own
        distinct, times = np.unique(codes, return_counts=True)
        names = distinct.tolist()
        for code in names:
            if code not in self.number:
                self.meet(code, np.array([code >> 32, -1, code & 0xFFFFFFFF], np.int32).tobytes())
        digest = hashlib.sha256(";".join(map(self.shown.__getitem__, codes.tolist())).encode()).hexdigest()
        self.docs.append((doc_id, len(a), len(b), len(codes), digest, np.array([self.number[c] for c in names], np.int64), times))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b and the number of documents of each id pair of the block."""
        owner, a, b = links(self.keys, self.pair)
        names, number = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        size = np.bincount(owner, minlength=len(self.keys))
        start = np.cumsum(size) - size
        docs, seen = np.zeros(len(names), np.int64), []
        for d in range(len(self.docs) + 1):  # in parts of documents, so that memory follows the block
            if d < len(self.docs):
                seen.append(self.docs[d][5])
            if seen and (d == len(self.docs) or len(seen) == 256):
                g = np.concatenate(seen)
                doc = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
                n = size[g]
                at = np.arange(n.sum()) + np.repeat(start[g] - (np.cumsum(n) - n), n)
                once = np.unique(np.repeat(doc, n) * len(names) + number[at])
                docs += np.bincount(once % max(len(names), 1), minlength=len(names))
                seen = []
        return (names >> 32).astype(np.int32), (names & 0xFFFFFFFF).astype(np.int32), docs

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        yield batch(0, block, len(self.docs), **{
            "doc_id": pa.array([d[0] for d in self.docs], pa.int64()), **{c: pa.array([d[1 + k] for d in self.docs], pa.int64()) for k, c in enumerate(("n_a", "n_b", "n_groups"))},
            "groups_sha256": pa.array([d[4] for d in self.docs]), **{c: pa.array([d[5 + k] for d in self.docs], pa.list_(pa.int32())) for k, c in enumerate(("groups", "times"))},
        })
        if self.keys:
            yield batch(1, block, len(self.keys), gid=pa.array(np.arange(len(self.keys), dtype=np.int32)), key=pa.array(self.keys, pa.binary()))
            a, b, docs = self.pairs()
            yield batch(2, block, len(a), a=pa.array(a), b=pa.array(b), docs=pa.array(docs))


TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def batch(kind: int, block: int, n: int, **held: pa.Array) -> pa.RecordBatch:
    """Rows of one kind (0: documents, 1: groups, 2: pairs): the columns of PARTS, null but for what they hold."""
    fields = dict(f.split() for f in PARTS.split(", "))
    held |= {"kind": pa.array(np.full(n, kind, np.int32)), "block": pa.array(np.full(n, block, np.int64))}
    return pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(n, TYPES[t]) for c, t in fields.items()], names=list(fields))


def dictionaries(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """PARTS: documents, groups and pairs of each block, written."""

    def run(batches):
        from pyspark import TaskContext

        pair, made = pair_of(a_path, b_path), 0
        own = Dictionary(pair)
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            texts = b.column("text").to_pylist()
            for doc_id, text, (x, y) in zip(b.column("doc_id").to_pylist(), texts, pair.encoded([t or "" for t in texts]), strict=True):
                own.add(doc_id, text, x, y)
                if own.bytes >= block_bytes:
                    yield from own.rows(TaskContext.get().partitionId() << 32 | made)
                    own, made = Dictionary(pair), made + 1
        if own.docs:
            yield from own.rows(TaskContext.get().partitionId() << 32 | made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PARTS)
    return materialise(rows, "align-parts")


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, docs (documents in which the pair is linked), best (1 where no other pair of the A id has more), written."""
    counts = materialise(parts.filter("kind = 2").groupBy("a", "b").agg(F.sum("docs").alias("docs")), "align-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of the vocabulary at most
    return materialise(counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")), "align-pairs")


def group_sums(parts: DataFrame, pairs: DataFrame, a_path: str, b_path: str, most_pairs: int) -> DataFrame:
    """key, n_best, count_sum of every distinct group: its links are expanded once."""

    def expand(batches):
        pair = pair_of(a_path, b_path)
        for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
            keys = b.column("key")
            owner, x, y = links(keys.to_pylist(), pair)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(x), pa.array(y)], names=["key", "a", "b"])

    distinct = parts.filter("kind = 1").select("key").distinct()
    held = F.broadcast(pairs) if pairs.count() <= most_pairs else pairs
    return distinct.mapInArrow(expand, "key binary, a int, b int").join(held, ["a", "b"]).groupBy("key").agg(F.sum("best").alias("n_best"), F.sum("docs").alias("count_sum"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(docs: pa.Table, groups: pa.Table) -> pa.Table:
    """RESULT rows of a block: what its groups sum, by their number, times how often a document has them."""
    n = groups.num_rows
    sums = [np.zeros(n, np.int64) for _ in range(2)]
    gid = groups.column("gid").to_numpy()
    for s, c in zip(sums, ("n_best", "count_sum"), strict=True):
        s[gid] = groups.column(c).to_numpy()
    held = docs.column("groups").combine_chunks()
    owner = np.repeat(np.arange(docs.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
    flat, times = (docs.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("groups", "times"))
    out = []
    for s in sums:
        total = np.zeros(docs.num_rows, np.int64)
        np.add.at(total, owner, s[flat] * times)
        out.append(pa.array(total))
    a, b, g = (docs.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))
    # Every end of a token closes a link; the ends of groups are shared by both sides.
    return pa.table([docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), pa.array(a + b - g), *out, docs.column("groups_sha256")], names=[f.split()[0] for f in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = 1 << 24, most_pairs: int = 1_000_000) -> DataFrame:
    """RESULT: one row for each row of ``docs`` (doc_id, text)."""
    parts = dictionaries(docs, a_path, b_path, block_bytes)
    sums = group_sums(parts, pair_counts(parts), a_path, b_path, most_pairs)
    groups = parts.filter("kind = 1").select("block", "gid", "key").join(sums, "key").select("block", "gid", "n_best", "count_sum")
    own = parts.filter("kind = 0").select(F.col("block").alias("at"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times")
    return own.groupBy("at").cogroup(groups.groupBy("block")).applyInArrow(summed, RESULT)
