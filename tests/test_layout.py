"""Indexed search, tiles and buckets: results, and what their plans read and shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens import carriers as C
from placelens.functions import geo
from placelens.operators import index, layout, nearest, search

SF = "/root/testdata/sf0.01"
REQUEST = search.Request(top_k=10, model_id="m", bands="rgb")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def chips(spark):
    return C.chips(spark, SF)


@pytest.fixture(scope="module")
def queries(spark, chips):
    some = chips.filter("vec_id % 41 = 0").select(F.col("chip_id").alias("concept"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return spark.createDataFrame(some.collect(), some.schema)


def brute(chips, queries, k):
    """The best places of each query by plain NumPy."""
    held = [(np.asarray(r["embedding"], float), r["chip_location_id"], r["source_cycle"]) for r in chips.collect()]
    out = set()
    for q in queries.collect():
        best = {}
        for v, place, cycle in held:
            s = v @ np.asarray(q["q"]) / np.linalg.norm(v) / np.linalg.norm(q["q"])
            best[place] = max(best.get(place, -2), s)
        out |= {(q["concept"], p, i, round(float(s), 9)) for i, (p, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


def test_batch_equals_brute_force_and_single_searches(spark, chips, queries):
    found = search.search_batch(chips.repartition(7), queries, REQUEST)
    assert {(r["concept"], r["chip_location_id"], r["rank"], round(r["score"], 9)) for r in found.collect()} == brute(chips, queries, 10)
    one = queries.first()
    single = {tuple(r) for r in search.search(chips, one["q"], REQUEST).select("rank", "chip_location_id", "winning_cycle", "cx", "ymax", "inside_aoi").collect()}
    assert single == {tuple(r) for r in found.filter(F.col("concept") == one["concept"]).select("rank", "chip_location_id", "winning_cycle", "cx", "ymax", "inside_aoi").collect()}


def test_batch_shuffles_no_vector(chips, queries):
    text = plan(search.search_batch(chips, queries, REQUEST))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    for line in text.splitlines():
        assert "Exchange" not in line or "embedding" not in line


def test_batch_ties_and_odd_vectors(spark):
    """Equal vectors, null, zero, NaN and other lengths, null places, more ties than k in one task, and queries without direction."""
    v = [[1.0, 0.0]] * 30 + [None, [0.0, 0.0], [float("nan"), 1.0], [1.0, 0.0, 0.0], [None, 1.0], []]
    data = [(f"p{i % 17:02d}" if i != 3 else None, str(2000 + i), i % 2 == 0, x, *[float(i)] * 6) for i, x in enumerate(v)]
    store = spark.createDataFrame(data, "chip_location_id string, source_cycle string, inside_aoi boolean, embedding array<float>, cx double, cy double, xmin double, ymin double, xmax double, ymax double")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0, 0.0]), (5, [float("nan"), 0.0])], "concept int, q array<double>")
    for parts in (1, 5):
        got = search.search_batch(store.repartition(parts), asked, search.Request(top_k=4)).orderBy("concept", "rank").collect()
        assert [(r["concept"], r["rank"], r["chip_location_id"], r["winning_cycle"]) for r in got] == [(1, 1, "p00", "2000"), (1, 2, "p01", "2001"), (1, 3, "p02", "2002"), (1, 4, "p03", "2020"), (4, 1, "p16", "2033")]
        assert [r["inside_aoi"] for r in got][:4] == [True, True, True, True]
    assert search.search_batch(store, asked.filter("false")).collect() == [] == search.search_batch(store.filter("false"), asked).collect()


def test_batch_in_parts(monkeypatch, chips, queries):
    whole = rows(search.search_batch(chips, queries, REQUEST).withColumn("score", F.round("score", 9)))
    monkeypatch.setattr(nearest, "BATCH_BYTES", 4 * 64 * 8)
    assert rows(search.search_batch(chips, queries, REQUEST).withColumn("score", F.round("score", 9))) == whole


@pytest.fixture(scope="module")
def made(spark, chips, tmp_path_factory):
    return index.build(spark, chips, str(tmp_path_factory.mktemp("index") / "t"), cells=12)


def test_index_holds_every_row_and_all_cells_are_exact(chips, made, queries):
    assert made.rows.count() == chips.count() and made.rows.select("chip_id").distinct().count() == chips.count()
    exact = rows(search.search_batch(chips, queries, REQUEST).withColumn("score", F.round("score", 9)))
    assert rows(index.search_index_batch(made, queries, REQUEST).withColumn("score", F.round("score", 9))) == exact
    assert rows(index.search_index_batch(made, queries, REQUEST, probes=12).withColumn("score", F.round("score", 9))) == exact


def test_index_prunes_partitions_and_reaches_recall(chips, made, queries):
    q = queries.first()["q"]
    pruned = index.search_index(made, q, REQUEST, probes=3)
    assert "PartitionFilters: [cell#" in plan(pruned) and " IN (" in plan(pruned)
    assert layout.files_read(made.rows.filter(F.col("cell").isin(*made.cells_of(q, 3)))) <= 3
    probes = index.probes_for(made, target=0.95, request=REQUEST)
    assert 1 <= probes <= 12
    found = index.search_index_batch(made, queries, REQUEST, probes=probes)
    assert index.recall(found, search.search_batch(chips, queries, REQUEST)).agg(F.avg("recall")).first()[0] >= 0.9


def test_index_of_clustered_vectors_needs_few_probes(spark, chips, tmp_path):
    """Around few directions a probe or two of many find nearly all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (10, 16))
    near = [(r["chip_id"], (centres[i % 10] + rng.normal(0, 0.1, 16)).tolist()) for i, r in enumerate(chips.select("chip_id").orderBy("chip_id").collect())]
    store = chips.drop("embedding").join(spark.createDataFrame(near, "chip_id string, embedding array<float>"), "chip_id")
    made = index.build(spark, store, str(tmp_path / "t"), cells=10)
    asked = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "concept int, q array<double>")
    found, exact = index.search_index_batch(made, asked, REQUEST, probes=2), search.search_batch(store, asked, REQUEST)
    assert index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_index_odd_vectors(spark, tmp_path):
    v = [[1.0, 0.0], [0.0, 1.0], [0.9, 0.1], None, [0.0, 0.0], [float("nan"), 1.0]]
    data = [(f"c{i}", f"p{i}", "2020", True, x, *[0.0] * 6) for i, x in enumerate(v)]
    store = spark.createDataFrame(data, "chip_id string, chip_location_id string, source_cycle string, inside_aoi boolean, embedding array<float>, cx double, cy double, xmin double, ymin double, xmax double, ymax double")
    made = index.build(spark, store, str(tmp_path / "t"), cells=2)
    assert {r["chip_id"] for r in made.rows.filter("cell = -1").collect()} == {"c3", "c4", "c5"} and made.rows.count() == 6
    assert [r["chip_location_id"] for r in index.search_index(made, [1.0, 0.0], search.Request(top_k=9), probes=2).collect()] == ["p0", "p2", "p1"]
    with pytest.raises(ValueError, match="no vector"):
        index.build(spark, store.filter("chip_id > 'c2'"), str(tmp_path / "u"), cells=2)
    with pytest.raises(ValueError, match="one length"):
        index.fit(store.withColumn("embedding", F.when(F.col("chip_id") == "c0", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))), 2)


def test_morton(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 2**30 + 7)]
    got = spark.createDataFrame(pairs, "x long, y long").select("x", "y", geo.morton(F.col("x"), F.col("y")).alias("m")).collect()
    for r in got:
        assert r["m"] == sum((r["x"] >> i & 1) << 2 * i | (r["y"] >> i & 1) << 2 * i + 1 for i in range(31))


BOXES = [{"bbox": (333900.0, 5139200.0, 334100.0, 5139300.0)}, {"near": (334600.0, 5139400.0, 150.0)}, {"bbox": (333424.0, 5139120.0, 333424.0, 5139120.0)}]


@pytest.mark.parametrize("options", BOXES)
def test_tiles_open_few_files_and_lose_no_row(spark, tmp_path, options):
    chips = C.chips(spark, "/root/testdata/sf0.1")
    folder, tiles = str(tmp_path / "t"), layout.Tiles(side=112.0)
    layout.write_tiled(chips, folder, tiles)
    request = search.Request(top_k=500, model_id="m", bands="rgb", **options)
    table = layout.read_tiled(spark, folder)
    assert table.count() == chips.count()
    few = layout.in_tiles(table, request, tiles)
    assert layout.files_read(table) == 400 and 0 < layout.files_read(few) < 40
    q = chips.first()["embedding"]
    assert rows(layout.search_tiled(spark, folder, q, request, tiles)) == rows(search.search(chips, q, request))
    assert "tile_x" in plan(layout.search_tiled(spark, folder, q, request, tiles)).split("PartitionFilters")[1].split("]")[0]


def test_tiles_refuse_wide_chips(spark, chips, tmp_path):
    with pytest.raises(Exception, match="reaches over"):
        layout.write_tiled(chips.withColumn("xmax", F.col("xmax") + 1), str(tmp_path / "t"))


def test_buckets_pool_without_exchange(spark, chips, tmp_path):
    table = layout.save_bucketed(chips, "bucketed_store", str(tmp_path / "b"), 4)
    q = chips.first()["embedding"]
    found = search.search(table, q, REQUEST)
    found.collect()
    assert "hashpartitioning" not in plan(found)
    assert rows(found) == rows(search.search(chips, q, REQUEST))
    marks = layout.save_bucketed(chips.filter("inside_aoi"), "bucketed_marks", str(tmp_path / "m"), 4).select("chip_location_id", "chip_id").withColumnRenamed("chip_id", "mark")
    met = layout.join_places(table.select("chip_location_id", "chip_id"), marks)
    assert "hashpartitioning" not in plan(met) and met.count() > 0
    spark.sql("DROP TABLE bucketed_store")
    spark.sql("DROP TABLE bucketed_marks")
