"""Lexical search, token alignment and the Hamming join, each against a brute-force version."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from placelens.llm import hamming_join, lexical_search, queries, token_alignment
from placelens.llm.common import table

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, k=10):
    held = [(d, TERM.findall(t.translate(FOLD))) for d, t in docs if t is not None]
    held = [(d, t) for d, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for d, t in held:
            tf, m = Counter(t), 25 + 75 * len(t) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in TERM.findall((text or "").translate(FOLD)) if tf[w])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "w1 W2 w3 w3 nothing"), (2, "one É漢字 of plain words"), (3, None), (4, ""), (5, "### !!"), (None, "w7 w8"), (6, "w5 w5 w6"), (6, "line words"), (7, "É ﬁ漢字1234")]


@pytest.mark.parametrize("limits", [{}, {"most_terms": 3, "most_links": 4, "block": 3}])
def test_rank(spark, odd, odd_rows, limits):
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, score int, doc_id int")
    got = sorted((tuple(r) for r in lexical_search.rank(odd, items, **limits).collect()), key=repr)
    assert got == brute_rank([r[:2] for r in odd_rows], ITEMS) and len(got) == 18


def test_rank_equals_sql(spark):
    got = queries.op11_lexical_search(spark, SMALL).toPandas()
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = db.sql(queries.ORACLES["op11_lexical_search"]).df()
    rows = lambda df: sorted(df[["item_id", "rank", "doc_id", "score"]].itertuples(index=False, name=None))
    assert rows(got) == rows(want) and len(want) > 100


def test_rank_empty(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.rank(empty, items).collect() == []
    assert lexical_search.rank(items.withColumnRenamed("item_id", "doc_id"), items.filter("false")).collect() == []


def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def brute_align(rows):
    """Every token occurrence by itself, with the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a_path, b_path = paths()
    first, second = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    plain = [c for c in range(256) if chr(c).isprintable() and c > 32 and c != 0xAD]
    letters = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    assert decoders.ByteLevel().decode([first.id_to_token(i) for i in (0, 262)]) == bytes(letters[c] for i in (0, 262) for c in first.id_to_token(i)).decode()

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found, counts = [], Counter()
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a_tokens = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        b_tokens = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if not text or b"".join(a_tokens) != whole or b"".join(b_tokens) != whole:
            found.append((d, 0, 0, 0, [], ""))
            continue
        x, y, links, start = spans(a_tokens), spans(b_tokens), [], 0
        for i, (s, e) in enumerate(x):
            while y[start][1] <= s:
                start += 1
            j = start
            while j < len(y) and y[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in x} & {e for _, e in y}):
            own = ([], [])
            while i < len(x) and x[i][1] <= end:
                own[0].append(a[i])
                i += 1
            while j < len(y) and y[j][1] <= end:
                own[1].append(b[j])
                j += 1
            groups.append("|".join(",".join(map(str, ids)) for ids in own))
        counts.update(set(links))
        found.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (a, _), c in counts.items():
        most[a] = max(most.get(a, 0), c)
    return sorted(((d, a, b, g, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), h) for d, a, b, g, links, h in found), key=repr)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 500, "most_pairs": 3}])
def test_align(spark, odd, odd_rows, limits):
    texts = ["<|endoftext|> <s> </s><unk>", "▁ under", "a\x00b\x07", "  two  blanks\n\n\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve coöperation 12345 ﬁ   　 🤷🏽‍♀️", "don't can't WE'LL"]
    rows = [r[:2] for r in odd_rows] + [(200 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, key string")
    got = sorted((tuple(r) for r in token_alignment.align(docs, *paths(), **limits).collect()), key=repr)
    assert got == brute_align(rows)


def test_align_documents(spark):
    docs = table(spark, SMALL, "documents")
    got = sorted((tuple(r) for r in token_alignment.align(docs, *paths()).collect()), key=repr)
    assert got == brute_align([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert token_alignment.align(docs.filter("false"), *paths()).collect() == []


def brute_groups(rows, threshold=85, width=3):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= threshold * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def family(seed, n=90, words=200, most=14):
    """Texts of one origin with up to ``most`` words changed: similarities from far below the threshold to above it."""
    rng = random.Random(seed)
    base = [f"f{seed}w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 4, "bucket": 3}])
def test_groups_of_families(spark, limits):
    texts = family(1) + family(2, n=40) + ["short text", "Short TEXT", "short  text\n", "one", "É one", "é one", "", None]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted((tuple(r) for r in hamming_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()), key=repr)
    assert got == brute_groups(rows)
    assert 20 < sum(r[3] for r in got) < 110


def test_groups_of_documents(spark, sf):
    docs = table(spark, sf, "documents").filter("n_chars < 3000 AND doc_id < 600")
    got = sorted((tuple(r) for r in hamming_join.near_duplicate_groups(docs).collect()), key=repr)
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_groups_edges(odd, odd_rows, empty):
    got = sorted((tuple(r) for r in hamming_join.near_duplicate_groups(odd).collect()), key=repr)
    assert got == brute_groups([r[:2] for r in odd_rows])
    assert hamming_join.near_duplicate_groups(empty).collect() == []


def test_signatures_within_the_distance_share_a_key():
    """The pigeonhole guarantee, for every distance that is allowed, with errors wherever they fall worst."""
    rng, symbols = np.random.default_rng(5), 64
    distance = hamming_join.allowed(0.85, 0.9999, symbols, 16)
    chunks = distance // 2 + 1
    for trial in range(400):
        x = rng.integers(0, 2**16, symbols, np.uint16)
        y = x.copy()
        wrong = rng.permutation(symbols)[:distance]
        if trial % 2:  # two errors a chunk, as far as they go
            parts = np.array_split(np.arange(symbols), chunks)
            wrong = np.concatenate([p[:2] for p in rng.permutation(np.array(parts, object))])[:distance]
        y[wrong] ^= 1
        keys = hamming_join.chunk_keys(np.stack([x, y]), chunks)
        assert keys.shape[1] == symbols and (keys[0] == keys[1]).any()


@pytest.mark.parametrize("similarity", [0.85, 0.9, 0.95])
def test_recall_by_similarity(similarity):
    """Signatures of pairs of random sets of a similarity are within the distance as often as promised."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1), rng.integers(0, 2**64, 64, np.uint64)
    distance, size, far = hamming_join.allowed(0.85, 0.9999, 64, 16), 400, 0
    both = math.ceil(2 * size * similarity / (1 + similarity))
    for _ in range(1500):
        s = hamming_join.mix(rng.integers(0, 2**63, 2 * size - both, np.uint64))
        x, y = (hamming_join.signature(t, a, b, 16) for t in (s[:size], s[size - both :]))
        far += (x != y).sum() > distance
    assert far <= 2
