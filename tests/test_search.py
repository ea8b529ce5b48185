"""Search over the small fixtures: ten places, three cycles, one vector a place but for place 5 in the last cycle."""

import numpy as np
import pytest
from placelens.functions import vectors
from placelens.operators import search as S
from placelens.plans import encoders
from placelens.schemas import CHIP_EMBEDDINGS
from pyspark.sql import functions as F

CYCLES = ("2090", "2091", "2092")


def unit(v):
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(5)
    return np.array([unit(v) for v in rng.normal(size=(10, 32))])


@pytest.fixture(scope="module")
def store(spark, vecs):
    rows = []
    for c in CYCLES:
        for i in range(10):
            v = unit(0.95 * vecs[5] + 0.05 * vecs[0]) if (i, c) == (5, "2092") else vecs[i]
            r, k = divmod(i, 4)
            x, y = 333424.0 + 224 * k, 5139120.0 + 224 * r
            rows.append(("default", "m", "rgb", c, f"naip_{c}_r{r:03d}_c{k:03d}", f"r{r:03d}_c{k:03d}", i < 5, [float(a) for a in v], x + 112, y + 112, x, y, x + 224, y + 224))
    return spark.createDataFrame(rows, CHIP_EMBEDDINGS).cache()


def places(df):
    return [r["chip_location_id"] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("engine", ["jvm", "arrow"])
def test_top_k(store, vecs, engine):
    got = S.search(store, vecs[7], S.Request(top_k=3, overfetch=30), engine).orderBy("rank").collect()
    assert got[0]["chip_location_id"] == "r001_c003" and got[0]["score"] == pytest.approx(1, abs=1e-5)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert got[0]["winning_cycle"] == "2090"  # equal scores: the smallest cycle


def test_max_pool(store, vecs):
    got = {r["chip_location_id"]: r for r in S.search(store, vecs[0], S.Request(overfetch=30)).collect()}
    assert got["r000_c000"]["rank"] == 1 and got["r001_c001"]["winning_cycle"] == "2092" and len(got) == 10


def test_filters(store, vecs):
    box = (333424.0, 5139120.0, 333424.0 + 4 * 224, 5139120.0 + 223)
    assert sorted(places(S.search(store, vecs[7], S.Request(bbox=box)))) == [f"r000_c00{i}" for i in range(4)]
    edge = (333424.0, 5139120.0, 333424.0, 5139120.0 + 224)  # touching counts
    assert sorted(places(S.search(store, vecs[7], S.Request(bbox=edge)))) == ["r000_c000", "r001_c000"]
    near = (333424 + 3 * 224 + 112.0, 5139120 + 224 + 112.0, 50.0)
    assert places(S.search(store, vecs[7], S.Request(near=near))) == ["r001_c003"]
    inside = places(S.search(store, vecs[7], S.Request(inside_aoi_only=True)))
    assert sorted(inside) == ["r000_c000", "r000_c001", "r000_c002", "r000_c003", "r001_c000"]
    assert S.search(store, vecs[7], S.Request(model_id="other")).collect() == []


def test_overfetch_may_return_fewer(store, vecs):
    assert S.search(store, vecs[7], S.Request(top_k=10, overfetch=10)).count() < 10
    assert S.default_overfetch(10) == 120 and S.default_overfetch(2) == 60


@pytest.mark.parametrize("request_", [S.Request(top_k=0), S.Request(top_k=5, overfetch=4)])
def test_bad_requests(store, vecs, request_):
    with pytest.raises(ValueError):
        S.search(store, vecs[0], request_)


def test_bad_vectors(store):
    for q in ([[1.0, 2.0]], [], 3.0):
        with pytest.raises(ValueError):
            S.search(store, q)


def test_vectors_without_direction_take_no_part(spark, store, vecs):
    bad = store.limit(1).withColumns({"chip_location_id": F.lit("zz"), "embedding": F.array_repeat(F.lit(0.0).cast("float"), 32)})
    nan = bad.withColumns({"chip_location_id": F.lit("nn"), "embedding": F.array_repeat(F.lit(float("nan")).cast("float"), 32)})
    for engine in ("jvm", "arrow"):
        assert not {"zz", "nn"} & set(places(S.search(store.unionByName(bad).unionByName(nan), vecs[7], S.Request(top_k=50), engine)))


def test_against_numpy(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(3, 30, 8))
    rows = [("default", "m", "rgb", str(2000 + c), f"c{c}_{i}", f"p{i:02d}", True, [float(x) for x in m[c, i]], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for c in range(3) for i in range(30)]
    q = rng.normal(size=8)
    cos = np.float32(m) @ q / np.linalg.norm(np.float32(m).astype(float), axis=2) / np.linalg.norm(q)
    best = cos.max(axis=0)
    order = np.argsort(-best)[:7]
    got = S.search(spark.createDataFrame(rows, CHIP_EMBEDDINGS), q, S.Request(top_k=7)).orderBy("rank").collect()
    assert [r["chip_location_id"] for r in got] == [f"p{i:02d}" for i in order]
    assert [r["winning_cycle"] for r in got] == [str(2000 + cos[:, i].argmax()) for i in order]
    assert np.allclose([r["score"] for r in got], best[order], atol=1e-6)


def test_batch_equals_single(spark, store, vecs):
    queries = spark.createDataFrame([(str(i), [float(x) for x in vecs[i]]) for i in range(4)], "concept string, q array<double>")
    batch = S.search_batch(store, queries, S.Request(top_k=3)).collect()
    for i in range(4):
        one = S.search(store, vecs[i], S.Request(top_k=3)).orderBy("rank").collect()
        assert [r["chip_location_id"] for r in sorted((r for r in batch if r["concept"] == str(i)), key=lambda r: r["rank"])] == [r["chip_location_id"] for r in one]


def test_batch_shuffles_no_vector(spark, store, vecs):
    """Once vectors were shuffled by place; now only what tasks keep of each query is, and flags of the places that were hit."""
    queries = spark.createDataFrame([("a", [float(x) for x in vecs[0]])], "concept string, q array<double>")
    plan = S.search_batch(store, queries, S.Request(top_k=3))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan and "NestedLoop" not in plan
    for line in plan.splitlines():
        if "MapInArrow" in line:
            depth = len(line) - len(line.lstrip(" :|+-"))
            below = plan[plan.index(line) + len(line) :].splitlines()[1:4]
            assert not any("Exchange" in x for x in below if len(x) - len(x.lstrip(" :|+-")) > depth)


def test_ensemble(spark):
    scores = {"m1": (0.9, 0.3, 0.7, 0.5), "m2": (0.1, 0.9, 0.5, 0.7)}
    rows = [("default", m, "rgb", "2020", f"c{i}", f"p{i}", True, [s, float(np.sqrt(1 - s * s))], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for m, v in scores.items() for i, s in enumerate(v)]
    df, q = spark.createDataFrame(rows, CHIP_EMBEDDINGS), [1.0, 0.0]
    got = S.search_ensemble(df, {"m1": q, "m2": q}, "m1").collect()
    assert {r["chip_location_id"]: round(r["score"], 4) for r in got} == {"p0": 0.5, "p1": 0.6, "p2": 0.6, "p3": 0.6}
    for queries, primary in (({"m1": q}, "m1"), ({}, "m1"), ({"m1": q, "m2": q}, "m3")):
        with pytest.raises(ValueError):
            S.search_ensemble(df, queries, primary)


def test_plan_shape(store, vecs, tmp_path):
    path = str(tmp_path / "t")
    store.write.partitionBy("experiment_id", "model_id", "bands", "source_cycle").parquet(path)
    df = S.search(store.sparkSession.read.schema(CHIP_EMBEDDINGS).parquet(path), vecs[0], S.Request(model_id="m", bands="rgb", bbox=(0.0, 0.0, 1e7, 1e7)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "PushedFilters: [IsNotNull" in plan and "PartitionFilters: [isnotnull" in plan


def test_ensemble_vector_and_quality(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 2.0]), ("b", [0.0, 5.0])], "k string, embedding array<double>")
    got = {r["k"]: r["q"] for r in vectors.gather(vectors.ensemble(rows, "k"), "k").collect()}
    assert np.allclose(got["a"], [0.5**0.5] * 2) and got["b"] == [0, 1]
    for bad in ([("a", [1.0, 0.0]), ("a", [-1.0, 0.0])], [("a", [0.0, 0.0])]):
        with pytest.raises(Exception, match="zero"):
            vectors.ensemble(spark.createDataFrame(bad, "k string, embedding array<double>"), "k").collect()
    q = vectors.quality(spark.createDataFrame([([1.0, 0.0],), ([2.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 0.0],), ([1.0],), (None,)], "embedding array<double>"), 2).first()
    assert tuple(q) == (6, 2, 2, 1, 2)


def test_lsh_recall(store, vecs):
    assert places(S.search_lsh(store, vecs[7], S.Request(top_k=1)))[0] == "r001_c003"


def test_preflight(store):
    assert S.preflight(store, "m", "rgb") == 30
    with pytest.raises(ValueError):
        S.preflight(store, "m", "cir")


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a road"), (2, "a road"), (3, None), (4, "")], "i int, text string")
    got = {r["i"]: r["embedding"] for r in encoders.encode_texts(df).collect()}
    assert got[1] == got[2] and got[3] is None and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5) and np.linalg.norm(got[4]) == pytest.approx(1)
    with pytest.raises(KeyError):
        encoders.encoder("none")
    with pytest.raises(ValueError):
        encoders.check_image(np.zeros((2, 4, 4), np.uint8))
    chips = spark.createDataFrame([("2020", "c1", bytearray(range(48)), 3, 4, 4), ("2022", "c2", bytearray(48), 3, 4, 4)], "cycle string, chip_id string, pixels binary, n_bands int, h int, w int")
    fresh = spark.createDataFrame([("hash-64", "rgb", "2020")], "model_id string, bands string, cycle string")
    assert [r["chip_id"] for r in encoders.embed_chips(chips, "hash-64", "rgb", fresh).collect()] == ["c2"]


def test_same_shape(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [1.0]), ("c", [1.0, 2.0])], "source_cycle string, embedding array<double>")
    ok = lambda **o: {r["source_cycle"]: r["ok"] for r in S.same_shape(rows, **o).collect()}
    assert ok() == {"a": True, "b": False, "c": False}
    assert ok(counts=False) == {"a": True, "b": True, "c": False}
