"""N-gram join, line deduplication, and the pipeline."""

from collections import Counter

import numpy as np
import pytest

from placelens.llm import graph, line_dedup, ngram_join
from placelens.llm.common import table
from pyspark.sql import functions as F


def shingle_set(text, width=5):
    w = text.encode().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else {text}


def brute_links(rows, threshold=0.8):
    sets = [shingle_set(t) if t is not None else None for _, t in rows]
    links = Counter()
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                continue
            both = len(a & b)
            if both >= threshold * (len(a) + len(b) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def test_ngram_join(spark, sf):
    docs = table(spark, sf, "documents").filter("n_chars < 4000 AND doc_id < 500")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs, block=8).collect()), key=repr)
    assert got == brute_links(rows)


def test_ngram_join_large_family_in_blocks(spark):
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=7).collect()), key=repr)
    assert got == brute_links(rows)


def test_ngram_join_edges(odd, odd_rows, empty):
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(odd).collect()), key=repr)
    assert got == brute_links([r[:2] for r in odd_rows])
    assert ngram_join.near_duplicates(empty).collect() == []
    one = ngram_join.one_of_each(odd)
    assert one.columns == odd.columns
    kept = Counter(r["doc_id"] for r in one.collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[6] == 1 and kept[8] == 1


def test_bands_reach_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 3)], "u long, v long")
    got = {r["node"]: r["label"] for r in graph.components(edges, "t").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


def brute_lines(rows, t=0.8):
    lines = [(i, k, n, frozenset(x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x)) for k, (i, text) in enumerate(rows) if text is not None for n, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[3]]
    order = sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    out = set()
    for a, (i, k, n, s) in enumerate(order):
        for *_, u in order[:a]:
            if len(s & u) >= t * len(s | u) - 1e-9:
                out.add((k, n))
                break
    return out


def test_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").filter("doc_id < 330").coalesce(1).orderBy("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    gone = brute_lines(rows)
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(docs).collect() for n in r["removed"]}
    assert got == {(rows[k][0], n) for k, n in gone} and len(got) > 50


@pytest.mark.parametrize(("crowd", "sketch"), [(64, 1 << 16), (2, 4)])
def test_line_dedup_near_lines(spark, monkeypatch, crowd, sketch):
    """Runs of two words, longer ones of crowded lines, and crowds of those, all against brute force."""
    import random

    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "SKETCH", sketch)

    rng = random.Random(2)
    rows = []
    for i in range(80):
        lines = []
        for base in range(4):
            w = [f"b{base}w{j}" for j in range(25)]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(25)] = f"x{rng.randrange(50)}"
            rng.shuffle(w)
            lines.append(" ".join(w))
        for size in (4, 5, 6, 9, 14):  # few words of few kinds: runs that many short lines share
            lines.append(" ".join(f"s{rng.randrange(size + 3)}" for _ in range(size)))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(docs).collect() for n in r["removed"]}
    assert got == {(rows[k][0], n) for k, n in brute_lines(rows)}


@pytest.mark.parametrize(("a", "b"), [("alpha", "beta"), ("w260498", "w397859"), ("w188379", "w217603"), ("w159283", "w198381")])
def test_line_dedup_words_that_collide(spark, a, b):
    """Two words of one prefix with the same 32 bits do not lose the pair."""
    common = "oa ob oc od oe of"
    lines = [f"ux {a} {b} {common}", common, common, common, f"uy {a} {b} {common}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(docs).collect() for n in r["removed"]}
    assert got == {(2, 0), (3, 0), (4, 0)} == {(k, n) for k, n in brute_lines(list(enumerate(lines)))}


def test_line_dedup_crowds_are_no_pairs(spark, monkeypatch):
    """What is crowded by longer runs too asks by a semi join on whole sets; parities drop no similar pair."""
    made, write = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    base = [f"c{j}" for j in range(24)]
    rows = [(i, " ".join([*base[:i], *(f"o{i}x{k}" for k in range(3 + i % 3)), *base[i + 1 :]])) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(docs).collect() for n in r["removed"]}
    assert got == {(rows[k][0], n) for k, n in brute_lines(rows)}
    assert any("Join LeftSemi" in p and "array_intersect" in p for p in made)


@pytest.mark.parametrize("run_tasks", [500_000, 200])
def test_line_dedup_about_wide_sets(spark, monkeypatch, run_tasks):
    """Lines about the size from which second parities count, just over and under the threshold; runs are dealt by their number."""
    import random

    made, write = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "RUNS_A_TASK", run_tasks)
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    rng, rows = random.Random(5), []
    for i, size in enumerate((line_dedup.WIDE - 8, line_dedup.WIDE, line_dedup.WIDE + 1, line_dedup.WIDE + 9, 150)):
        base = [f"w{i}x{j}" for j in range(size)]
        most = int(size - 0.8 * size)  # words left out of a similar line
        for k, (out, new) in enumerate([(0, 0), (most, 0), (most + 1, 0), (size // 9, size // 9), (size // 9 + 1, size // 9 + 1)]):
            left = rng.sample(base, size - out) + [f"n{i}x{k}x{j}" for j in range(new)]
            rng.shuffle(left)
            rows.append((len(rows), " ".join(left)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(docs).collect() for n in r["removed"]}
    assert got == {(rows[k][0], n) for k, n in brute_lines(rows)} and len(got) > 5
    dealt = [p.split("RepartitionByExpression [key#")[1].split("], ")[1].split()[0] for name, p in made if name == "line-runs"]
    assert len(set(dealt)) == 1 and (int(dealt[0]) == 1) == (run_tasks == 500_000)


def test_line_dedup_edges(odd, odd_rows, empty):
    docs = odd.coalesce(1)
    got = line_dedup.removed_lines(docs).collect()
    assert len(got) == len(odd_rows)
    gone = brute_lines([r[:2] for r in odd_rows])
    assert Counter((r["doc_id"], n) for r in got for n in r["removed"]) == Counter((odd_rows[k][0], n) for k, n in gone)
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == odd.columns and cleaned.count() == len(odd_rows)
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert texts[6] is None and texts[4] == "" and texts[10] == "last words of a text"
    assert line_dedup.removed_lines(empty).collect() == [] and line_dedup.clean(empty).collect() == []


def test_similar_sets_share_runs():
    """The prefix bounds, by all sizes of two sets and all placings of their own words that a search finds worst."""
    import random

    rng, t = random.Random(7), 0.8
    length = lambda n, r: min(n, int((r + 1) * (1 - t) * n + 1e-9) + r + 1)
    for _ in range(20000):
        n1, n2 = rng.randrange(4, 60), rng.randrange(4, 60)
        both = -(-t * (n1 + n2) / (1 + t) // 1)
        both = int(both) + (both < t * (n1 + n2) / (1 + t) - 1e-9)
        if both > min(n1, n2):
            continue
        early = rng.random() < 0.7  # words of one set alone before most shared ones
        draw = lambda: rng.random() ** (3 if early else 1)
        shared = [rng.random() for _ in range(both)]
        x = sorted(shared + [draw() for _ in range(n1 - both)])
        y = sorted(shared + [draw() for _ in range(n2 - both)])
        for r in line_dedup.RUNS:
            if min(n1, n2) >= line_dedup.least_size(r, t):
                runs = [{tuple(s[i : i + r + 1]) for i in range(length(len(s), r) - r)} for s in (x, y)]
                assert runs[0] & runs[1], (n1, n2, r)


def inputs_of(spark, docs):
    """The same rows as a scan, dealt anew, as a join's result and sorted."""
    some = spark.range(10**6).select(F.col("id").alias("doc_id"), F.lit(1).alias("one"))
    return [docs, docs.repartition(5), docs.join(some, "doc_id").drop("one"), docs.repartition(3).sort(F.desc("n_chars"))]


def test_results_do_not_hang_on_the_plan(spark, sf):
    """Line dedup, n-gram join and mixing keep their rows' identity whatever plan gives the input."""
    from placelens.llm import mixing

    docs = table(spark, sf, "documents").filter("doc_id < 200 AND n_chars < 8000")
    for way, column in ((line_dedup.clean, "text"), (ngram_join.one_of_each, "text"), (mixing.mixed_documents, "text"), (mixing.mix, "taken")):
        first, *others = [sorted((tuple(r) for r in way(d).select("doc_id", column).collect()), key=repr) for d in inputs_of(spark, docs)]
        assert len(first) > 100 and all(first == x for x in others)


def test_native_plan(spark, sf):
    plan = line_dedup.removed_lines(table(spark, sf, "documents").limit(50))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage against what it says, on its own input."""
    import corpus_pipeline as P
    from placelens.llm import language_id, mixing

    docs = table(spark, sf, "documents").filter("doc_id < 300")
    columns, sizes = docs.columns, [docs.count()]
    before = [r.asDict() for r in docs.collect()]
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        nxt = spark.read.parquet(str(tmp_path / str(i)))
        if name == "language ID":
            bad = {r["doc_id"] for r in language_id.identify(docs).filter("rejected").collect()}
            assert {r["doc_id"] for r in nxt.collect()} == {r["doc_id"] for r in before} - bad
        elif name == "line dedup":
            rows = sorted(((r["doc_id"], r["text"]) for r in before), key=lambda r: r[0])
            gone = brute_lines(rows)
            want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, (d, t) in enumerate(rows)}
            assert {r["doc_id"]: r["text"] for r in nxt.collect()} == {d: t for d, t in want.items() if t.split()}
            assert all(r["n_chars"] == len(r["text"]) for r in nxt.collect())
        elif name.startswith("n-gram"):
            rows = [(r["doc_id"], r["text"]) for r in before]
            assert {r["doc_id"] for r in nxt.collect()} == {c for _, c, _ in brute_links(rows)}
        elif name.startswith("mixing"):
            got, taken = Counter(r["doc_id"] for r in nxt.collect()), {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
            assert all(abs(got[d] - t / s) < 1 for d, (t, s) in taken.items())
        if name != "packing":
            assert nxt.columns == columns
            before = [r.asDict() for r in nxt.collect()]
        docs = nxt
        sizes.append(docs.count())
    assert sum(r["length"] for r in docs.select("length").collect()) > 0 and sizes[1] > 280


def test_pipeline_stages_chain_without_writing(spark, sf):
    """A stage keeps the tables that its input, not yet run, still reads; run() leaves nothing but its last table."""
    import corpus_pipeline as P

    docs = table(spark, sf, "documents").filter("doc_id < 60")
    mixed = P.mix_sources(spark, P.join_ngrams(spark, docs, sf), sf)
    assert P.pack_sequences(spark, mixed, sf).count() > 0


def test_pipeline_deletes_what_its_stages_wrote(spark, monkeypatch, tmp_path):
    import os

    import corpus_pipeline as P
    from placelens.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [os.listdir(tmp_path / d) for d in os.listdir(tmp_path)] == [["4"]]
