"""Sharding, mixing, packing and search."""

import zlib
from collections import Counter, defaultdict

import math

import numpy as np
import pytest

from placelens.llm import mixing, packing, sharding, topk_search
from placelens.llm.common import table
from pyspark.sql import functions as F
from placelens.llm.queries import tokenizer_path


def check_shards(rows, n, shards=24):
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert sum(map(len, per.values())) == n
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    sizes = [len(per.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return per


def test_sharding(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sharding.interleave_shards(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_shards(rows, len(texts))
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)
    whole = Counter(r["source"] for r in rows)
    for shard in range(24):  # every shard has its part of every source, but for a row
        part = Counter(r["source"] for r in rows if r["shard"] == shard)
        assert all(abs(part[s] - n / 24) <= 2 for s, n in whole.items())
    again = sharding.interleave_shards(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_sharding_edges(odd, odd_rows, empty):
    check_shards(sharding.interleave_shards(odd).collect(), len(odd_rows))
    assert sharding.interleave_shards(empty).collect() == []


def test_share_out():
    assert mixing.share_out([10, 10], [1, 1], 10) == [5, 5]
    assert mixing.share_out([1, 100], [3, 1], 50) == [2, 48]
    assert mixing.share_out([0, 0], [3, 1], 0) == [0, 0]
    t = mixing.share_out([5, 50, 500], [3, 1, 2], 1.5 * 555)
    assert sum(t) == pytest.approx(1.5 * 555) and all(x <= 2 * s + 1e-9 for x, s in zip(t, [5, 50, 500]))


def test_van_der_corput():
    assert mixing.van_der_corput(np.arange(5)).tolist() == [0, 0.5, 0.25, 0.75, 0.125]


def test_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}


def test_mixing_brute_force(spark):
    """Slots replayed one by one over the streams' words."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (3 + i * 7 % 40)), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    rows = mixing.materialise(mixing.stream_rows(docs.withColumn("__row", F.monotonically_increasing_id()), 11), "t").collect()
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_tokens=8).collect()}
    streams = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["__order"], r["doc_id"])):
        streams[r["source"]] += [r["doc_id"]] * r["size"]
    names = sorted(streams)
    targets = mixing.share_out([len(streams[s]) for s in names], [3.0, 1.0, 2.0], 1.5 * sum(map(len, streams.values())))
    want, rank = Counter(), Counter()
    for i in range(round(sum(targets) / 8)):
        u = mixing.van_der_corput(np.array([i]))[0] * sum(targets)
        s = names[int(np.searchsorted(np.cumsum(targets), u, side="right"))]
        blocks = -(-len(streams[s]) // 8)
        if rank[s] < 2 * blocks:
            b = rank[s] % blocks
            want.update(streams[s][8 * b : 8 * b + 8])
        rank[s] += 1
    assert got == {i: want[i] for i in range(60)}


def test_mixing_edges(odd, odd_rows, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(empty).collect() == []


def round_robin(units, credits):
    """The queue of each quantum: deficits kept one round after the other."""
    left, deficit, out = list(units), [packing.QUANTUM // 2] * len(units), []
    while any(left):
        for q, c in enumerate(credits):
            deficit[q] += int(c)
            while left[q] and deficit[q] >= packing.QUANTUM:
                deficit[q] -= packing.QUANTUM
                left[q] -= 1
                out.append(q)
    return out


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 1, 1, 1, 1], [5, 0.01, 2, 100, 1, 1, 3]])
def test_slots_are_those_of_deficit_round_robin(weights):
    units = np.array([1, 50, 0, 7, 13, 200, 3])
    credits = packing.credits_of(units if weights is None else weights, 8)
    want = round_robin(units, credits)
    queue = np.repeat(np.arange(len(units)), units)
    k = np.concatenate([np.arange(u) for u in units])
    got = packing.slots_of(queue, k, units, credits)
    assert sorted(got.tolist()) == list(range(len(want)))
    assert [want[x] for x in got] == queue.tolist()
    if weights is None:  # carried deficits stay within a few quanta, window after window
        for x in range(0, len(want), 8):
            assert all(abs((got[queue == q] < x).sum() - u * x / units.sum()) <= 2 for q, u in enumerate(units))


def test_slots_of_many_queues():
    units = np.random.default_rng(0).integers(0, 9, 5000)
    credits = packing.credits_of(units, 32)
    queue, k = np.repeat(np.arange(5000), units), np.concatenate([np.arange(u) for u in units])
    want = round_robin(units, credits)
    assert [want[x] for x in packing.slots_of(queue, k, units, credits)] == queue.tolist()


def test_packing_to_target_weights(spark):
    """Windows hold the weights' shares until a queue is empty, and no token is lost after that."""
    texts = [(i, " ".join(f"w{i * 7 + j}" for j in range(300)), ("a", "b", None)[i % 3]) for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = packing.pack(docs, tokenizer_path(), length=1024, quantum=32, weights={"a": 6, "b": 3, None: 1}).collect()
    check_packing(rows, [(i, t) for i, t, _ in texts], 1024)
    per, last = defaultdict(Counter), {}
    for r in rows:
        per[r["sequence_id"]][r["source"]] += r["length"]
        last[r["source"]] = max(last.get(r["source"], 0), r["sequence_id"])
    whole = sum(r["length"] for r in rows if r["source"] == "a")
    full = [s for s in range(whole * 10 // 6 // 1024 - 2)]
    assert len(full) > 10
    assert all(abs(per[s][q] - 1024 * w) <= 3 * 32 for s in full for q, w in (("a", 0.6), ("b", 0.3), (None, 0.1)))
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), weights={"a": 0})


@pytest.mark.parametrize("name", [None, "byte_bpe_50k.json"])
def test_encoder_is_exact(spark, sf, name):
    """Also with a vocabulary that joins blanks to words, which takes whole texts."""
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path(name) if name else tokenizer_path()

    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(300).collect()]
    texts += ["a's İstanbul ΣΑΣ, É. don't 12,3.. x.., y Á. <|endoftext|>. ﬁx Ǆ", None, "", " ", "\r\ta b", "É.\n,b .c,.d., e", "ab.\r c.", "é,", "ªb. ºC, µ."]
    coder = packing.Encoder(path, 2)
    assert coder.parts == (name is None)
    for t, ids in zip(texts, coder(pa.array(texts)).to_pylist(), strict=True):
        assert np.frombuffer(ids, coder.dtype).tolist() == coder.model.encode(t or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts, length=4096):
    """Every id once, in place; sequences gapless, full or of a power of two."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(model.encode(t or "", add_special_tokens=False).ids + [2])
    assert set(want) == set(pieces)
    for i, docs in want.items():
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                ids = docs[0][r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and r["doc_tokens"] == len(docs[0]) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += r["length"]
            assert at == len(docs[0])
    assert sum(r["length"] for r in rows) == sum(len(d) for docs in want.values() for d in docs)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for off, n in sorted(parts):
            assert off == end and n > 0
            end += n
        assert end <= length and end & (end - 1) == 0


def test_packing(spark, sf):
    docs = table(spark, sf, "documents").limit(400)
    rows = packing.pack(docs, tokenizer_path()).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    whole, n = Counter(), len({r["sequence_id"] for r in rows})
    for r in rows:
        whole[r["source"]] += r["length"]
    total = sum(whole.values())
    for seq in range(n):  # every full window has the mixture of the whole, within a few quanta
        part = Counter()
        for r in rows:
            if r["sequence_id"] == seq:
                part[r["source"]] += r["length"]
        if sum(part.values()) == 4096 and seq < n - 3:
            assert all(abs(part[s] - 4096 * w / total) <= 4 * 128 for s, w in whole.items())


def test_packing_edges(odd, odd_rows, empty):
    rows = packing.pack(odd, tokenizer_path()).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows])
    assert packing.pack(empty, tokenizer_path()).collect() == []


def brute_top(rows, k=5, every=50):
    held = [(i, np.floor(256 * np.asarray(v, np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, u in {(i, tuple(v)) for i, v in held if i % every == 0}:
        best = sorted((-int(np.dot(u, v)), i) for i, v in held if i != q and len(v) == len(u))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_search(spark, sf):
    e = table(spark, sf, "embeddings").limit(300)
    got = {tuple(r) for r in topk_search.top_k(e, row_block=64, query_block=3, seeds=50).collect()}
    assert got == brute_top([(r["vec_id"], r["embedding"]) for r in e.collect()])


def test_search_ties_and_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (3, [0.5, 0.25]), (4, [0.5, 0.25]), (50, [1.0, -1.0]), (7, [0.1, 0.2]), (8, None), (9, []), (100, [float("nan"), 1.0]), (101, [None, 1.0]), (102, [float("inf"), 0.0]), (150, [0.1, 0.2, 0.3]), (151, [0.1, 0.1, 0.1]), (None, [9.0, 9.0]), (4, [0.5, 0.25]), (200, [0.5]), (50, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk_search.top_k(df.selectExpr("vec_id", "embedding", "1 as score", "2 as rank")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows)
    assert topk_search.top_k(df.filter("false")).collect() == []


def test_bounds_never_cut_the_best(spark):
    rng = np.random.default_rng(0)
    q, v = rng.integers(-300, 300, (20, 64)).astype(float), rng.integers(-300, 300, (500, 64)).astype(float)
    for s in topk_search.levels(64):
        assert (topk_search.statistics(q, s) @ topk_search.statistics(v, s).T >= q @ v.T - 1e-6).all()


def test_bounds_skip_pairs(spark, sf):
    """Of all pairs, how many are scored; with vectors around few centres the bounds skip most."""
    x = np.array([r["embedding"] for r in table(spark, sf, "embeddings").filter("size(embedding) = 64").orderBy("vec_id").limit(1000).collect()])
    n = len(x)
    centres = np.repeat(np.random.default_rng(1).normal(0, 1, (5, 4)), 16, axis=1)
    near = centres[np.arange(n) % 5] + np.random.default_rng(2).normal(0, 0.05, (n, 64))
    for v, most in ((x, 0.7), (near, 0.35)):
        v = np.floor(256 * v).astype(np.int64)
        search = topk_search.Search(np.arange(0, n, 50), v[::50], 5)
        for at in range(0, n, 100):
            search.see(np.arange(at, min(n, at + 100)), v[at : at + 100])
        assert 0 < search.scored < most * search.pairs
        got = {}
        for w, name, score in zip(search.who.tolist(), search.names.tolist(), search.scores.tolist(), strict=True):
            got.setdefault(w, []).append((-score, name))
        for w, best in got.items():
            s = v @ v[50 * w]
            assert best == sorted((-int(s[i]), i) for i in range(n) if i != 50 * w)[:5]


def test_search_large_integers(spark):
    """Products beyond the 53 bits of a double are exact, and those beyond 64 bits are cut to them."""
    a, b = 1_000_003.3, 1_000_001.7
    rows = [(0, [a * 1.0] * 4), (1, [b] * 4), (2, [b, b, b, b + 0.01]), (50, [1e17] * 4), (3, [-1e17] * 4)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for (q, v), score in got.items():
        assert score == max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[q], whole[v], strict=True))))
    assert len(got) == 8


@pytest.mark.parametrize("rows", [
    [(0, [1e17] * 4), (1, [-1e17] * 4)], [(0, [-(2.0**55)]), (1, [2.0**55])], [(0, [4e16, -3.7e16]), (1, [1.0, 1.0])],
    [(0, [1e300, -1e300, 1.0]), (1, [1.0, 1.0, 3.5]), (2, [1e300, 1e300, 2.0]), (3, [0.1, 0.2, 1e17])], [(0, [-(2.0**24)] * 2), (1, [2.0**24 + 0.5] * 2), (50, [3.0, 2.0**45])],
])
@pytest.mark.parametrize("parts", [1, 4])
def test_search_integers_of_any_size(spark, rows, parts):
    """Alone in a batch or beside others, scores are the exact products, cut to 64 bits."""
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)).collect()}
    whole = {i: [math.floor(256 * x) if abs(x) < 2**60 else 256 * int(x) for x in v] for i, v in rows}
    assert got == {(q, v): max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[v], strict=True)))) for q in whole if q % 50 == 0 for v in whole if v != q}


def test_search_in_several_passes(spark, sf):
    e = table(spark, sf, "embeddings").limit(400)
    got = {tuple(r) for r in topk_search.top_k(e, every=7, row_block=64, query_block=4, blocks=3, seeds=50).collect()}
    assert got == brute_top([(r["vec_id"], r["embedding"]) for r in e.collect()], every=7)
