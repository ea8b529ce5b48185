"""Ranked lexical search: the product of an item-term matrix and a term-document matrix of integer impacts, in blocks.

Texts are read once: every document gives its number of terms and the counts of those terms that some item holds. The
statistics of all documents follow from that table. Items then meet it in blocks of documents: in a block, a term's row holds the
documents with it and their impacts, 64-bit integers; an item's row of scores is the sum of the rows of its terms times their
multiplicity, merged in a dense row of the block (Gustavson's algorithm). A task keeps the ``k`` best documents of each item,
the final ranking first reduces those of groups of tasks, then all.

What travels to tasks is bounded: the items' vocabulary up to ``most_terms`` terms, beyond which postings meet it by a shuffle;
items in parts of about ``most_links`` term occurrences, each with a pass over the postings, which are far smaller than the texts.

Defined results: texts that are null or without a term take no part in any count; an item without text or known terms has no
row; documents of score 0 are left out; ties go to the smaller doc_id, null ids last; repeated documents are ranked each; rows of
one item_id are items of their own, with ranks of their own; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

#: Letters A-Z fold to lower case, other ASCII but digits and letters parts terms, all bytes of other characters are kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))
FOUND = "item long, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item, term, times: the rows of the item-term matrix."""

    def run(batches):
        for b in batches:
            for item, text in zip(b.column("item"), b.column("text").to_pylist(), strict=True):
                held = Counter(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["item", "term", "times"])

    return items.filter("text IS NOT NULL").select("item", "text").mapInArrow(run, "item long, term binary, times long")


def counted(docs: DataFrame, vocabulary: DataFrame, most_terms: int) -> DataFrame:
    """row, doc_id, n, terms, counts: every document with a term, and which terms of the vocabulary (term, id) it holds how often; written."""
    few = vocabulary.count() <= most_terms
    known = docs.sparkSession.sparkContext.broadcast({bytes(r["term"]): r["id"] for r in vocabulary.collect()}) if few else None
    kind = pa.int64() if few else pa.binary()

    def run(batches):
        ids = known.value if few else None
        for b in batches:
            sizes, held, counts = [], [], []
            for text in b.column("text").to_pylist():
                found = terms(text)
                seen = Counter(found)
                mine = sorted(ids.keys() & seen.keys()) if few else list(seen)
                sizes.append(len(found))
                held.append([ids[t] for t in mine] if few else mine)
                counts.append([seen[t] for t in mine])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(kind)), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    some = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = some.mapInArrow(run, f"doc_id long, n long, terms array<{'long' if few else 'binary'}>, counts array<long>").filter("n > 0")
    if few:
        return materialise(rows, "search-postings")
    rows, _ = numbered(rows, "row")
    pairs = rows.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.counts").alias("c"))
    held = pairs.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("id", "c")).alias("held"))
    none = F.array().cast("array<long>")
    merged = rows.select("row", "doc_id", "n").join(held, "row", "left")
    return materialise(merged.select("doc_id", "n", F.coalesce("held.id", none).alias("terms"), F.coalesce("held.c", none).alias("counts")), "search-postings")


class Matrix:
    """Items by terms: ``terms`` sorted ids, ``weights`` of each, and for each item its terms (places in ``terms``) and their multiplicity."""

    def __init__(self, rows: list, documents: int):
        self.terms = np.unique(np.array([r["id"] for r in rows], np.int64))
        self.weights = np.zeros(len(self.terms), np.int64)
        self.items: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            t = int(np.searchsorted(self.terms, r["id"]))
            self.weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
            self.items.setdefault(r["item"], []).append((t, r["times"]))


class Block:
    """The rows of the term-document matrix for a block of documents."""

    def __init__(self, n: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray, matrix: Matrix, documents: int, length: int):
        m = np.array([25 + 75 * x * documents // length for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        place = np.minimum(np.searchsorted(matrix.terms, term), len(matrix.terms) - 1)
        asked = matrix.terms[place] == term
        doc, place, count = doc[asked], place[asked], count[asked]
        order = np.argsort(place, kind="stable")
        self.docs, place, count = doc[order], place[order], count[order]
        self.impacts = matrix.weights[place] * (1_000_000_000 * count // (1000 * count + 8 * m[self.docs]))
        self.starts = np.searchsorted(place, np.arange(len(matrix.terms) + 1))
        self.row = np.zeros(len(n), np.int64)

    def scores(self, item: list[tuple[int, int]]) -> np.ndarray:
        """The item's row of the product: rows of its terms merged; documents are distinct within each."""
        self.row[:] = 0
        for t, times in item:
            s, e = self.starts[t], self.starts[t + 1]
            self.row[self.docs[s:e]] += times * self.impacts[s:e]
        return self.row


def best(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id, rows without id last."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], none[at], -score[at]))][:k]


def multiplied(postings: DataFrame, matrix: Matrix, documents: int, length: int, k: int, block: int) -> DataFrame:
    """FOUND: the ``k`` best documents of each item among those of each task."""
    shared = postings.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        q = shared.value
        held = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for item in q.items}
        for b in (whole.slice(i, block) for whole in batches for i in range(0, whole.num_rows, block)):
            none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts")]
            sizes = b.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            rows = Block(b.column("n").to_numpy(zero_copy_only=False), *flat, sizes, q, documents, length)
            for item, row in q.items.items():
                score = rows.scores(row)
                old, names, absent = held[item]
                least = max(int(old[-1]), 1) if len(old) == k else 1
                at = np.flatnonzero(score >= least)
                if len(at):
                    score, names, absent = np.concatenate([old, score[at]]), np.concatenate([names, ids[at]]), np.concatenate([absent, none[at]])
                    top = best(score, names, absent, k)
                    held[item] = (score[top], names[top], absent[top])
        for item, (score, names, absent) in held.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int64()), pa.array(names, pa.int64(), mask=absent), pa.array(score)], names=["item", "doc_id", "score"])

    return postings.select("doc_id", "n", "terms", "counts").mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = 1 << 20, most_links: int = 1 << 22, block: int = 8192) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents for each item; docs: doc_id, text; items: item_id, text."""
    items, _ = numbered(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item")
    links = materialise(item_terms(items), "search-items")
    vocabulary, _ = numbered(links.select("term").distinct(), "id")
    postings = counted(docs, vocabulary, most_terms)
    total = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    frequency = postings.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    asked = materialise(links.join(vocabulary, "term").join(frequency, "id").select("item", "id", "times", "df"), "search-asked")
    parts, found = -(-asked.count() // most_links), []
    for p in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == p).collect()  # about most_links
        if rows:
            near = multiplied(postings, Matrix(rows, total["documents"]), total["documents"], total["length"], k, block)
            found.append(materialise(near, "search-found") if parts > 1 else near)
    out = found[0] if found else asked.sparkSession.createDataFrame([], FOUND)
    for more in found[1:]:
        out = out.union(more)
    first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for group in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*first))).filter(F.col("rank") <= k)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
