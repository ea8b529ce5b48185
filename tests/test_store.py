"""Store, documents, configuration, runner, streaming, API."""

import json

import numpy as np
import pytest
from placelens import carriers as C
from placelens.functions import text
from placelens.operators import catalog, grid, store
from placelens.plans import api, config, runner
from placelens.session import resolve
from placelens.sources import documents as D
from placelens.streaming.ingest import ingest
from pyspark.sql import functions as F


@pytest.fixture
def chips(spark):
    return grid.per_cycle(grid.build(spark, (333424.0, 5139120.0, 333900.0, 5139500.0)), ["2018", "2020"], C.AOI)


def vectors_of(chips, model="m", bands="rgb", value=1.0):
    return chips.select(F.lit(model).alias("model_id"), F.lit(bands).alias("bands"), F.col("cycle").alias("source_cycle"), "chip_id", F.array(F.lit(value).cast("float"), F.col("row").cast("float")).alias("embedding"))


def test_load_is_idempotent_and_exact(spark, chips, tmp_path):
    folder, rows = str(tmp_path / "t"), vectors_of(chips)
    n = chips.filter("cycle = '2018'").count()
    assert store.load(spark, folder, rows, chips) == {"2018": n, "2020": n}
    store.load(spark, folder, rows, chips)
    got = store.read(spark, folder)
    assert got.count() == 2 * n and got.join(rows, ["source_cycle", "chip_id", "embedding"]).count() == 2 * n
    assert got.filter("chip_location_id <> substring(chip_id, 11, 20)").count() == 0
    store.load(spark, folder, vectors_of(chips, value=2.0), chips, cycles=["2020"])
    again = {r["source_cycle"]: (r["v"], r["n"]) for r in store.read(spark, folder).groupBy("source_cycle").agg(F.max(F.col("embedding")[0]).alias("v"), F.count("*").alias("n")).collect()}
    assert again == {"2018": (1.0, n), "2020": (2.0, n)}


def test_orphans_and_unknown_cycles_are_errors(spark, chips, tmp_path):
    bad = vectors_of(chips).limit(1).withColumn("chip_id", F.lit("naip_2018_r999_c999"))
    with pytest.raises(ValueError, match="not in chip_index"):
        store.load(spark, str(tmp_path / "t"), bad, chips)
    with pytest.raises(ValueError, match="not in the index"):
        store.load(spark, str(tmp_path / "t"), vectors_of(chips), chips, cycles=["1999"])


def test_delete(spark, chips, tmp_path):
    folder = str(tmp_path / "t")
    for model, bands in (("a", "rgb"), ("a", "cir"), ("b", "rgb")):
        store.load(spark, folder, vectors_of(chips, model, bands), chips, clear=True)
    store.delete(spark, folder, "a", "cir")
    left = lambda: {tuple(r) for r in store.read(spark, folder).select("model_id", "bands").distinct().collect()}
    assert left() == {("a", "rgb"), ("b", "rgb")}
    store.load(spark, folder, vectors_of(chips, "a", "cir"), chips)
    store.delete(spark, folder, "a")
    assert left() == {("b", "rgb")}


@pytest.mark.parametrize("model", ["ViT-L/14", "a:b=c%d", "x y", "é"])
def test_delete_ids_that_folders_escape(spark, chips, tmp_path, model):
    folder = str(tmp_path / "t")
    store.load(spark, folder, vectors_of(chips, model), chips)
    store.load(spark, folder, vectors_of(chips, "other"), chips)
    store.delete(spark, folder, model)
    assert {r[0] for r in store.read(spark, folder).select("model_id").distinct().collect()} == {"other"}
    store.load(spark, folder, vectors_of(chips, model), chips)
    store.load(spark, folder, vectors_of(chips, model, value=3.0).filter("source_cycle = '2018'"), chips, clear=True)
    assert {tuple(r) for r in store.read(spark, folder).filter(F.col("model_id") == model).select("source_cycle", F.col("embedding")[0]).distinct().collect()} == {("2018", 3.0)}


def test_upsert_touches_only_its_cycles(spark, chips, tmp_path):
    folder = str(tmp_path / "t")
    store.load(spark, folder, vectors_of(chips), chips)
    files = lambda c: {r[0] for r in store.read(spark, folder).filter(F.col("source_cycle") == c).select("_metadata.file_path").distinct().collect()}
    before = files("2018"), files("2020")
    store.load(spark, folder, vectors_of(chips, value=2.0), chips, cycles=["2020"])
    assert files("2018") == before[0] and not files("2020") & before[1]
    # A chip that moves to another cycle leaves the old one; a cycle that loses its last chip goes.
    rows = store.read(spark, folder)
    moved = spark.createDataFrame(rows.filter("source_cycle = '2018'").withColumn("source_cycle", F.lit("2022")).collect(), rows.schema)
    store.upsert(spark, folder, moved)
    assert {r[0]: r[1] for r in store.read(spark, folder).groupBy("source_cycle").count().collect()} == {"2020": moved.count(), "2022": moved.count()}


def test_upserted_prefers_new(spark):
    old = spark.createDataFrame([("e", "m", "b", "1", 0), ("e", "m", "b", "2", 0)], "experiment_id string, model_id string, bands string, chip_id string, v int")
    new = spark.createDataFrame([("e", "m", "b", "2", 1), ("e", "m", "b", "3", 1), ("e", "m", "b", "3", 2)], old.schema)
    assert {(r["chip_id"], r["v"]) for r in store.upserted(old, new, order="v").collect()} == {("1", 0), ("2", 1), ("3", 2)}


def test_location_prefix(spark):
    df = spark.createDataFrame([("naip_2018_r001_c002", "2018")], "c string, y string")
    assert df.select(text.location_of_chip(F.col("c"), F.col("y"))).first()[0] == "r001_c002"
    with pytest.raises(Exception, match="prefix"):
        df.select(text.location_of_chip(F.col("c"), F.lit("2020"))).collect()
    assert df.select(text.location_of_chip(F.col("c"), F.lit("2020"), strict=False)).first()[0] == "naip_2018_r001_c002"


def test_chip_index_round_trip(spark, chips, tmp_path):
    look = spark.createDataFrame([("f", "2018", "naip_2018_r000_c000"), ("f", "2020", "naip_2020_r000_c000")], "feature_id string, cycle string, chip_id string")
    n = chips.agg(F.max("col") + 1).first()[0]
    value = D.chip_index_json({"working_crs": "EPSG:26916", "n_cols": n, "n_rows": 4, "aoi_bounds_26916": [1.0, 2.0, 3.0, 4.0]}, chips, look).first()["value"]
    path = str(tmp_path / "index.json")
    D.write_text(value, path)
    meta, back, lookup = D.read_chip_index(spark, path)
    keys = ["cycle", "chip_id", "row", "col", "loc_idx", "xmin", "ymax", "cx", "inside_aoi", "chip_location_id"]
    assert {tuple(r) for r in back.select(keys).collect()} == {tuple(r) for r in chips.select(keys).collect()}
    assert {tuple(r) for r in lookup.collect()} == {tuple(r) for r in look.collect()} and meta.first()["aoi_bounds_26916"] == [1, 2, 3, 4]
    assert D.one_cycle(back, "2018").count() == chips.count() / 2
    with pytest.raises(ValueError):
        D.one_cycle(back, "1900")


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a", "properties": {"name": "A", "type": "dam"}, "geometry": {"type": "Point", "coordinates": [1.0005, 2.0]}}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    p = D.read_points(spark, str(tmp_path / "p.json"))
    assert p.select("id", "type", "findable_aerial", "x", "y").first() == ("a", "dam", None, 1.0005, 2.0)
    out = json.loads(D.features_json(p).first()["value"])
    assert out["features"][0]["properties"]["name"] == "A" and out["crs"]["properties"]["name"].endswith("::26916")
    area = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 0]]]}}]}
    (tmp_path / "a.json").write_text(json.dumps(area))
    ring, bounds = D.read_area(spark, str(tmp_path / "a.json"))
    assert ring[1] == (4.0, 0.0) and tuple(bounds.first()) == (0, 0, 4, 3)


def test_manifests(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"cycles": [{"year": "2018", "items": [{"item_id": "i", "assets": {"image": "u"}}]}]}))
    (tmp_path / "s.json").write_text(json.dumps({"scenes": [{"item_id": "s", "cloud_cover": 3.5}]}))
    (tmp_path / "bad.json").write_text("{ not json")
    assert D.manifest_items(spark, str(tmp_path / "n.json"), "naip").first()["year"] == "2018"
    assert D.manifest_items(spark, str(tmp_path / "s.json"), "s2").first()["cloud_cover"] == 3.5
    for name in ("bad.json", "none.json"):
        assert D.manifest_items(spark, str(tmp_path / name), "s2").collect() == []
    urls = spark.createDataFrame([("http://x/a?sig=1", None), ("http://x/b?sig=1", "http://y/b")], "s string, o string")
    assert [r[0] for r in urls.select(D.unsigned_url(F.col("s"), F.col("o"))).collect()] == ["http://x/a", "http://y/b"]


def test_npy(spark, tmp_path):
    m = np.arange(8, dtype=np.float32).reshape(4, 2)
    np.save(tmp_path / "m__rgb__2018.npy", m)
    (tmp_path / "m__rgb__2018.json").write_text(json.dumps({"chip_ids": list("abcd")}))
    got = {r["chip_id"]: r["embedding"] for r in D.read_npy(spark, str(tmp_path)).collect()}
    assert got == {c: m[i].tolist() for i, c in enumerate("abcd")}
    assert D.file_digests(spark, str(tmp_path)).count() == 2
    np.save(tmp_path / "m__rgb__2018.npy", m.astype(np.float64))
    with pytest.raises(Exception, match="float64"):
        D.read_npy(spark, str(tmp_path)).collect()
    paths = spark.createDataFrame([("/x/m__rgb__2018.npy",), ("/x/n__cir__2018.npy",), ("/x/odd.npy",), ("/x/m__rgb__2018.json",)], "path string")
    assert [r[0] for r in store.models_of_files(paths, "rgb").collect()] == ["m"]


def test_config(tmp_path, monkeypatch):
    good = "experiment_id: e\naoi_id: a\neval_set_id: v\nmodel_id: m\nmodality: aerial\nbands: rgb\nchip_params: {chip_size_m: 224, stride_m: 112}\ncycles: [2018, '2020']\n"
    path = tmp_path / "e.yaml"
    path.write_text(good)
    e = config.read_experiment(str(path))
    assert e.cycles == ("2018", "2020") and e.chip_size == 224 and e.stride == 112 and e.model_id == "m"
    monkeypatch.setenv("PLACELENS_EXPERIMENT", str(path))
    assert config.read_experiment().experiment_id == "e" and config.config_path("x").name == "x"
    with pytest.raises(FileNotFoundError):
        config.read_experiment(str(tmp_path / "none.yaml"))
    path.write_text("- a")
    with pytest.raises(ValueError, match="not a mapping"):
        config.read_experiment()
    path.write_text(good.replace("stride_m: 112", "stride_m: 1.5").replace("bands: rgb", "bands: ''").replace("aoi_id: a\n", "").replace("cycles: [2018, '2020']", "cycles: []"))
    with pytest.raises(ValueError) as faults:  # all at once
        config.read_experiment()
    assert all(w in str(faults.value) for w in ("aoi_id is missing", "bands is not a text", "chip_params.stride_m is not a whole number", "cycles is not a list"))
    assert config.checked({"a": 1, "z": 9}, (config.Field("a", config.metres), config.Field("b.c", config.text, "d", False))) == {"a": 1, "c": "d", "z": 9}
    assert config.is_stale(str(tmp_path / "t"), str(path)) and resolve("PLACELENS_NONE", None, "d") == "d"


def test_runner():
    log = []
    stages = [runner.Stage(n, f"does {n}", lambda n=n: log.append(n)) for n in "abc"]
    assert [s.name for s in runner.pick(stages, "b")] == ["b", "c"] and [s.name for s in runner.pick(stages, only="a")] == ["a"]
    with pytest.raises(ValueError):
        runner.pick(stages, "c", "a")
    with pytest.raises(ValueError):
        runner.pick(stages, only="z")
    runner.run(stages, dry=True)
    assert log == [] and "does b" in runner.plan_text(stages)
    bad = [stages[0], runner.Stage("x", "", lambda: 1 / 0), stages[2]]
    with pytest.raises(RuntimeError, match="stage x failed after a"):
        runner.run(bad)
    assert log == ["a"]
    purged = []
    assert runner.swap_model("a", "b", str, lambda m: True, purged.append) and not runner.swap_model("a", "b", str, lambda m: False, purged.append) and purged == ["a"]
    with pytest.raises(ValueError):
        runner.swap_model("a", "a", str, bool, str)


def test_keys(spark):
    keys = ["", ".", "..", "a/b", "a\\b", "../x", "fine.png"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(text.is_flat_key(F.col("k"))).collect()] == [False] * 6 + [True]
    t = spark.createDataFrame([("a__2018__rgb.png",), ("a__2018__rgb.jpg",), ("a__rgb.png",), ("a__2018__xyz.png",)], "k string")
    assert [r[0] for r in t.select(text.thumbnail_status(F.col("k"))).collect()] == [200, 400, 400, 400]


def test_prompts():
    assert len(text.CONCEPTS) == 12 and all(len(text.prompts(c)) >= 6 for c in text.CONCEPTS)
    assert text.prompts_for(" Parking Lot ") == text.prompts("parking_lot")
    assert text.prompts_for("old mill")[0] == "an aerial photo of old mill" and len(text.prompts_for("old mill")) == 8


def test_api(spark, chips, tmp_path):
    folder = str(tmp_path / "t")
    e = vectors_of(chips, "hash-64").withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("chip_id").substr(12, 3).cast("int") + 1)).cast("float")))
    store.load(spark, folder, e, chips)
    got = api.search_text(spark, store.read(spark, folder), "waterfall", top_k=3).orderBy("rank").collect()
    assert len(got) == 3 and len(got[0]["ring"]) == 5 and got[0]["ring"][0] == got[0]["ring"][4] and 46 < got[0]["lat"] < 47 and got[0]["thumbnail"].endswith("__rgb.png")
    for words, k in (("", 3), ("x" * 501, 3), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            api.search_text(spark, store.read(spark, folder), words, top_k=k)
    assert api.health(spark, store.read(spark, folder))["has_rows"]


def test_streaming_upsert(spark, chips, tmp_path):
    drop, folder = str(tmp_path / "drop"), str(tmp_path / "t")
    rows = store.columns(store.join_chips(vectors_of(chips), chips))
    for value in (1.0, 2.0):
        rows.withColumn("embedding", F.array(F.lit(value).cast("float"))).write.mode("append").parquet(drop)
        ingest(spark, drop, folder, str(tmp_path / "ckpt")).awaitTermination()
    got = store.read(spark, folder)
    assert got.count() == chips.count() and got.select(F.col("embedding")[0]).distinct().first()[0] == 2.0


def test_stale_cells(spark):
    now = spark.createDataFrame([(1, "i", None, "t"), (2, "i", "w", "t"), (3, "i", "w", "t")], "cell int, index_sha string, weights_sha string, tag string")
    old = spark.createDataFrame([(1, "i", None, "t"), (2, "i", "v", "t")], now.schema)
    assert sorted(r["cell"] for r in catalog.stale(old, now, ["cell"]).collect()) == [2, 3]
