"""A run of an experiment from inputs in degrees to the report, on synthetic imagery."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import raster, store
from placelens.plans import encoders, experiment
from placelens.plans.config import checked
from placelens.sources import cells, documents

CONCEPTS = [("dam", "dam", "a dam"), ("road", "road", "a road"), ("sky", None, "sky")]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """An area with a hole, three features, and two source rasters for each of two cycles."""
    root = str(tmp_path_factory.mktemp("run"))
    lon0, lat0, lon1, lat1 = -89.15, 46.40, -89.143, 46.405
    ring = [[lon0, lat0], [lon1, lat0], [lon1, lat1], [lon0, lat1], [lon0, lat0]]
    hole = [[lon0 + 0.001, lat0 + 0.001], [lon0 + 0.001, lat0 + 0.0012], [lon0 + 0.0012, lat0 + 0.0012], [lon0 + 0.001, lat0 + 0.001]]
    at = experiment.Folders(root, "e")
    experiment.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, hole]}}]}), at.area("a", False))
    points = [("p1", "dam", lon0 + 0.002, lat0 + 0.002, True), ("p2", "road", lon0 + 0.005, lat0 + 0.003, True), ("p3", "road", lon0 + 0.004, lat0 + 0.004, False)]
    features = [{"type": "Feature", "id": i, "properties": {"type": t, "findable_aerial": f}, "geometry": {"type": "Point", "coordinates": [x, y]}} for i, t, x, y, f in points]
    experiment.write_text(json.dumps({"type": "FeatureCollection", "features": features}), at.points("v", False))
    experiment.write_text(json.dumps({"models": {"hash-64": {"arch": "hash", "embed_dim": 64, "sha256": "w1"}}}), at.weights)
    (x, y), rng = spark.range(1).select(*geo.to_utm(F.lit(lon0), F.lit(lat0))).first(), np.random.default_rng(1)
    left, top = float(np.floor(x)) - 400, float(np.floor(y)) + 1000
    for cycle in ("2018", "2020"):
        meta = spark.createDataFrame([("w", left, top, 8.0, 180, 90), ("x", left + 640, top, 8.0, 180, 90)], raster.META)
        rows = [(r, b, i, j, int(v)) for r in ("w", "x") for b in (1, 2, 3) for (i, j), v in np.ndenumerate(rng.integers(1, 255, (180, 90)))]
        raster.write(raster.cut(spark.createDataFrame(rows, "raster string, band int, row int, col int, value int"), meta, 64), at.sources(cycle))
        meta.write.parquet(at.source_meta(cycle))
    return root


def run_of(spark, root, model="hash-64", cycles=("2018", "2020")):
    e = checked({"experiment_id": "e", "aoi_id": "a", "eval_set_id": "v", "model_id": model, "modality": "aerial", "bands": "rgb", "chip_params": {"chip_size_m": 224, "stride_m": 112}, "cycles": list(cycles)})
    return experiment.Run(spark, e, root, CONCEPTS, side=64, pixel=8.0)


def test_run_from_degrees_to_report(spark, root):
    run = run_of(spark, root)
    done = run.run()
    assert list(done) == ["reproject", "mosaics", "index", "embed", "load", "evaluate"]
    assert "5 vertices" not in done["reproject"] and "9 vertices and 3 points" in done["reproject"] and done["mosaics"] == ["2018", "2020"] and done["index"] is True
    meta, chips, lookup = run.index()
    n = chips.count() // 2
    assert n > 20 and done["load"] == {"2018": n, "2020": n} and lookup.count() == 6
    assert documents.read_rings(spark, run.at.area("a", True)).count() == 2  # the hole is kept
    told = {r["source_cycle"]: r for r in cells.sidecars(spark, run.at.cells).collect()}
    assert told["2018"]["n_chips"] == n and told["2018"]["weights_sha"] == "w1" and told["2018"]["embed_dim"] == 64
    results = json.loads(experiment.read_text(run.at.document("results.json")))
    assert results["n_chips"] == n and set(results["per_config"]) == {"hash-64__rgb"} and set(results["per_config"]["hash-64__rgb"]) == {"findable", "strict"}
    assert results["gt_sizes"]["strict"]["road"] > results["gt_sizes"]["findable"]["road"] > 0 == results["gt_sizes"]["strict"]["sky"]
    assert "## F. Checks" in experiment.read_text(run.at.document("report.md"))


def test_what_is_fresh_is_not_made_again(spark, root):
    run = run_of(spark, root)
    again = run.run(first="mosaics", last="embed")
    assert again == {"mosaics": [], "index": False, "embed": []}
    experiment.write_text(json.dumps({"models": {"hash-64": {"arch": "hash", "embed_dim": 64, "sha256": "w2"}}}), run.at.weights)
    assert [c[2] for c in run.embed()] == ["2018", "2020"]  # other weights


def test_swap_of_models(spark, root):
    run = run_of(spark, root)
    encoders.register("hash-32", lambda: encoders.HashEncoder(32), 32)
    models = lambda: {r[0] for r in store.read(spark, run.at.store).select("model_id").distinct().collect()}
    make = lambda model: run_of(spark, root, model)
    assert not experiment.swap(make, "hash-64", "hash-32", lambda _: False) and models() == {"hash-64"}
    assert experiment.swap(make, "hash-64", "hash-32", lambda _: True) and models() == {"hash-32"}
    with pytest.raises(ValueError):
        experiment.swap(make, "hash-32", "hash-32")


def test_digest_passes_over_what_does_not_matter(spark):
    base = {"b": [1, {"z": 1.5, "a": "é\"x"}], "a": {"k": None, "j": True}, "generated_at": "t1", "eval_lookup": {"f": []}}
    others = [dict(reversed(base.items())), base | {"generated_at": "t2", "eval_lookup": {"g": [1]}}, {k: v for k, v in base.items() if k != "generated_at"}]
    different = [base | {"b": [{"z": 1.5, "a": "é\"x"}, 1]}, base | {"a": {"k": None, "j": False}}, base | {"c": 1}]
    rows = spark.createDataFrame([(json.dumps(d, indent=i),) for i, d in enumerate([base, *others, *different])], "value string")
    got = [r["d"] for r in rows.select(experiment.index_digest(F.col("value")).alias("d")).collect()]
    assert len(set(got[:4])) == 1 and len(set(got)) == 4


def test_folders_and_area(spark, root):
    at = experiment.Folders(root, "e")
    assert experiment.area_document(spark, at, "a")["geojson"]["type"] == "FeatureCollection"
    with pytest.raises(FileNotFoundError):
        experiment.area_document(spark, at, "none")
    for bad in ("..", "", "x/y"):
        with pytest.raises(ValueError):
            at.document(bad)
    assert experiment.weights_of(spark, at.weights, "none") == {} == experiment.weights_of(spark, f"{root}/no.json", "m")
