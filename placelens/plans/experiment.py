"""A whole run of an experiment on real operators: inputs to metres, chip index, mosaics, embeddings, store, evaluation, report.

Stages read what earlier ones have written under one root and write their own, so a run may start at any of them; what is not
stale is not made again. Network fetches are left to others: imagery comes as tables of tiles (``operators.raster``).
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, stats, text, vectors
from ..operators import areas, evaluation, grid, raster, store, sweep
from ..sources import cells, documents
from ..sources.catalog import file_system
from . import encoders, runner
from .config import Experiment
from .report import gate_report


@dataclass(frozen=True)
class Folders:
    """Where a run keeps things, by role; nothing is made by asking."""

    root: str
    experiment_id: str

    def _at(self, *parts: str) -> str:
        for p in parts:
            if not p or p in (".", "..") or "/" in p:
                raise ValueError(f"{p!r} cannot name a part of a path")
        return "/".join((self.root.rstrip("/"), *parts))

    def area(self, aoi_id: str, metres: bool) -> str:
        return self._at("areas", f"{aoi_id}.{'metres' if metres else 'degrees'}.json")

    def points(self, eval_set_id: str, metres: bool) -> str:
        return self._at("points", f"{eval_set_id}.{'metres' if metres else 'degrees'}.json")

    def sources(self, cycle: str) -> str:
        """Tiles of a cycle's source rasters; their meta lies beside them."""
        return self._at("imagery", cycle, "tiles")

    def source_meta(self, cycle: str) -> str:
        return self._at("imagery", cycle, "meta")

    def mosaic(self, cycle: str) -> str:
        return self._at("mosaics", cycle)

    @property
    def weights(self) -> str:
        return self._at("weights.json")

    @property
    def index(self) -> str:
        return self._at(self.experiment_id, "chip_index.json")

    @property
    def cells(self) -> str:
        return self._at(self.experiment_id, "cells")

    @property
    def store(self) -> str:
        return self._at("chip_embeddings")

    def document(self, name: str) -> str:
        return self._at(self.experiment_id, name)


def read_text(path: str) -> str | None:
    """A small document, or None where there is none."""
    system, at = file_system(path)
    if system.get_file_info(at).is_file:
        with system.open_input_stream(at) as f:
            return f.read().decode("utf-8")
    return None


def write_text(value: str, path: str) -> bool:
    """Replace a small document as a whole; False, and nothing is written, where it holds this already."""
    if read_text(path) == value:
        return False
    system, at = file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{at}.part") as f:
        f.write(value.encode("utf-8"))
    system.move(f"{at}.part", at)
    return True


def is_stale(target: str, *inputs: str) -> bool:
    """Whether a document is absent or older than an input, in any file system."""

    def time(path: str):
        system, at = file_system(path)
        return system.get_file_info(at).mtime

    made = time(target)
    return made is None or any((t := time(i)) is not None and t > made for i in inputs)


def weights_of(spark: SparkSession, path: str, model_id: str) -> dict:
    """The manifest's entry of a model (arch, embed_dim, image_size, sha256, tag); a model without weights has none of these."""
    if read_text(path) is None:
        return {}
    entry = "arch: string, embed_dim: int, image_size: int, sha256: string, open_clip_pretrained_tag: string, weights_path: string"
    rows = documents.read_json(spark, path, f"models map<string, struct<{entry}>>").select(F.col("models")[model_id].alias("m")).select("m.*").collect()
    found = rows[0].asDict() if rows and rows[0]["arch"] is not None else {}
    return {"tag" if k == "open_clip_pretrained_tag" else k: v for k, v in found.items()}


def index_digest(value: Column, without: tuple[str, ...] = ("generated_at", "eval_lookup")) -> Column:
    """The digest of a JSON object but for keys that do not matter to embeddings: the order of keys and blanks do not count."""
    held = F.map_filter(F.from_json(value, "map<string, variant>"), lambda k, _: ~k.isin(*without))
    parts = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(held[k])))
    return F.sha2(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), 256)


@dataclass
class Run:
    """An experiment under a root, with the search's concepts (concept, feature_type, words) and its encoder."""

    spark: SparkSession
    experiment: Experiment
    root: str
    concepts: list[tuple[str, str | None, str]]
    side: int = 256
    pixel: float = 1.0
    facts: dict = field(default_factory=dict)

    @property
    def at(self) -> Folders:
        return Folders(self.root, self.experiment.experiment_id)

    # ---- inputs -----------------------------------------------------------------------------------------------------

    def reproject(self) -> str:
        """Area and points in metres, as documents, and the report of how well they come back."""
        e, at = self.experiment, self.at
        rings = documents.read_rings(self.spark, at.area(e.aoi_id, False))
        moved = rings.withColumn("points", areas.rings_to_utm(F.col("points")))
        write_text(documents.area_json(moved).first()["value"], at.area(e.aoi_id, True))
        points = documents.read_points(self.spark, at.points(e.eval_set_id, False))
        x, y = geo.to_utm(F.col("x"), F.col("y"))
        write_text(documents.features_json(points.withColumns({"x": x, "y": y})).first()["value"], at.points(e.eval_set_id, True))
        report = crs_report(rings, points, e.aoi_id, e.eval_set_id)
        write_text(report, at.document("crs.txt"))
        return report

    def area(self) -> tuple[list, tuple[float, float, float, float]]:
        ring, bounds = documents.read_area(self.spark, self.at.area(self.experiment.aoi_id, True))
        return ring, tuple(bounds.first())

    def points(self) -> DataFrame:
        return documents.read_points(self.spark, self.at.points(self.experiment.eval_set_id, True))

    # ---- chips ------------------------------------------------------------------------------------------------------

    def build_index(self) -> bool:
        """The chip index as one document, unless it is newer than area and points; whether it was made."""
        e, at = self.experiment, self.at
        if not is_stale(at.index, at.area(e.aoi_id, True), at.points(e.eval_set_id, True)):
            return False
        ring, bounds = self.area()
        origin = grid.origin_and_dims(self.spark.createDataFrame([bounds], "west double, south double, east double, north double"), e.stride).first()
        chips = grid.per_cycle(grid.build(self.spark, bounds, e.chip_size, e.stride), list(e.cycles), ring)
        # Every point must lie in a chip.
        primary = grid.primary_chip(self.points(), chips.filter(F.col("cycle") == e.cycles[0]), origin["ow"], origin["os"], "id", strict=True)
        lookup = grid.eval_lookup(primary, list(e.cycles), "id").withColumnRenamed("id", "feature_id")
        meta = {"generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "working_crs": "EPSG:26916", "chip_size_m": e.chip_size, "stride_m": e.stride, "grid_origin_26916": [origin["ow"], origin["os"]], "n_rows": origin["n_rows"], "n_cols": origin["n_cols"], "aoi_bounds_26916": list(bounds)}
        shape = round(e.chip_size / self.pixel)
        extra = self.spark.createDataFrame([(c, self.at.mosaic(c), self.pixel, [shape, shape, 4]) for c in e.cycles], "year string, source_cog string, native_pixel_size_m double, native_chip_array_shape array<int>")
        return write_text(documents.chip_index_json(meta, chips, lookup, extra).first()["value"], at.index)

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return documents.read_chip_index(self.spark, self.at.index)

    def build_mosaics(self) -> list[str]:
        """The mosaic of each cycle over the area's bounds, from its source tiles; cycles that have one are passed over."""
        ring, bounds = self.area()
        grid_ = raster.Grid.around(tuple(float(v) for v in geo_buffer(bounds)), self.pixel, self.side)
        made = []
        for cycle in self.experiment.cycles:
            system, path = file_system(self.at.mosaic(cycle))
            if system.get_file_info(f"{path}/_SUCCESS").is_file:
                continue
            tiles, meta = raster.read(self.spark, self.at.sources(cycle)), self.spark.read.parquet(self.at.source_meta(cycle))
            blocks = raster.mosaic(tiles, meta, grid_, side=self.side).withColumn("raster", F.lit(cycle))
            blocks.select([f.split()[0] for f in raster.TILES.split(", ")]).repartition("band", "tile_row").write.mode("overwrite").partitionBy("raster", "band", "tile_row").parquet(self.at.mosaic(cycle))
            made.append(cycle)
        return made

    def embed(self) -> list[tuple[str, str, str]]:
        """Cells of all cycles that are stale: chips cut from the mosaics and encoded, with provenance."""
        e = self.experiment
        _, bounds = self.area()
        g = raster.Grid.around(tuple(float(v) for v in geo_buffer(bounds)), self.pixel, self.side)
        _, chips, _ = self.index()
        digest = self.spark.read.text(self.at.index, wholetext=True).select(index_digest(F.col("value")).alias("d")).first()["d"]
        weights = weights_of(self.spark, self.at.weights, e.model_id)
        facts = {"index_sha": digest, "weights_sha": weights.get("sha256"), "tag": weights.get("tag")}
        bands = list(range(1, 4)) if e.bands == "rgb" else [4, 1, 2] if e.bands == "cir" else [int(b) for b in e.bands.split("-")]

        def make(cell: tuple[str, str, str]) -> DataFrame:
            meta = self.spark.createDataFrame([(cell[2], g.left, g.top, g.pixel, g.height, g.width)], raster.META)
            own = chips.filter(F.col("cycle") == cell[2])
            windows = raster.windows_of(own.select("chip_id", F.col("cycle").alias("raster"), "xmin", "ymin", "xmax", "ymax"), meta, "chip_id")
            cut = raster.read_windows(raster.read(self.spark, self.at.mosaic(cell[2])), windows, "chip_id", bands, self.side)
            return encoded(cut, bands, e.model_id).join(own.select("chip_id", F.col("loc_idx").alias("position")), "chip_id").select("position", "chip_id", "embedding")

        return cells.embed_stale(self.spark, self.at.cells, [((e.model_id, e.bands, c), facts) for c in e.cycles], make)

    def load(self) -> dict[str, int]:
        """Embeddings joined with the index and upserted into the store, in place of what the experiment had; rows a cycle."""
        e = self.experiment
        rows = cells.read_cells(self.spark, self.at.cells).filter((F.col("model_id") == e.model_id) & (F.col("bands") == e.bands))
        cells.check_order(rows.withColumn("chip_location_id", text.location_of_chip(F.col("chip_id"), F.col("source_cycle"))))
        _, chips, _ = self.index()
        return store.load(self.spark, self.at.store, rows.drop("position").withColumn("experiment_id", F.lit(e.experiment_id)), chips, list(e.cycles), clear=True)

    # ---- evaluation -------------------------------------------------------------------------------------------------

    def metrics(self) -> DataFrame:
        """variant, config, concept, n_gt, k, hit, recall, mrr of every concept, against findable and all features."""
        e, spark = self.experiment, self.spark
        rows = store.read(spark, self.at.store).filter(F.col("experiment_id") == e.experiment_id)
        # A concept is asked by the mean of its prompts.
        prompts = spark.createDataFrame([(c, p) for c, _, words in self.concepts for p in text.prompts_for(words)], "concept string, text string")
        q = vectors.mean_directions(encoders.encode_texts(prompts, e.model_id), "concept")
        asked = q.select(F.lit(e.model_id).alias("model_id"), F.lit(e.bands).alias("bands"), "concept", "q")
        asked = spark.createDataFrame(asked.collect(), asked.schema)  # a row a concept
        meta, chips, _ = self.index()
        origin, places = meta.select("grid_origin_26916").first()[0], chips.filter(F.col("cycle") == e.cycles[0])
        table = spark.createDataFrame([(c, t, i) for i, (c, t, _) in enumerate(self.concepts)], "concept string, feature_type string, ord int")
        out = None
        for variant, findable in (("findable", True), ("strict", False)):
            truth = evaluation.ground_truth(self.points().withColumnRenamed("id", "feature_id"), table, places, *origin, findable)
            got = sweep.evaluate(rows, asked, truth).withColumn("variant", F.lit(variant))
            out = got if out is None else out.unionByName(got)
        return out

    def evaluate(self) -> dict:
        """The results as one document, and the report; what the document holds."""
        e = self.experiment
        rows = self.spark.createDataFrame(self.metrics().collect(), "config string, concept string, n_gt long, k int, hit double, recall double, mrr double, variant string")  # concepts x k
        _, chips, _ = self.index()
        n = chips.filter(F.col("cycle") == e.cycles[0]).count()
        out: dict = {"experiment_id": e.experiment_id, "n_chips": n, "cycles": list(e.cycles), "per_config": {}, "random_baseline": {}, "gt_sizes": {"findable": {}, "strict": {}}}
        for r in rows.orderBy("config", "variant", "concept", "k").collect():
            m = out["per_config"].setdefault(r["config"], {}).setdefault(r["variant"], {}).setdefault(r["concept"], {"mrr": r["mrr"], "hit_at_k": {}, "recall_at_k": {}})
            m["hit_at_k"][str(r["k"])], m["recall_at_k"][str(r["k"])] = r["hit"], r["recall"]
            out["gt_sizes"][r["variant"]][r["concept"]] = r["n_gt"]
        out["n_configs"] = len(out["per_config"])
        sizes = rows.groupBy("variant", "concept").agg(F.max("n_gt").alias("n_gt"))
        base = sizes.withColumn("k", F.explode(F.array(*map(F.lit, evaluation.KS)))).select("variant", "concept", "k", stats.random_hit(F.lit(n), F.col("n_gt"), F.col("k")).alias("hit"), stats.random_recall(F.lit(n), F.col("n_gt"), F.col("k")).alias("recall"), stats.random_mrr(F.lit(n), F.col("n_gt")).alias("mrr"))
        for r in base.orderBy("variant", "concept", "k").collect():
            m = out["random_baseline"].setdefault(r["variant"], {}).setdefault(r["concept"], {"mrr": r["mrr"], "hit_at_k": {}, "recall_at_k": {}})
            m["hit_at_k"][str(r["k"])], m["recall_at_k"][str(r["k"])] = r["hit"], r["recall"]
        write_text(json.dumps({"generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), **out}, indent=2), self.at.document("results.json"))
        write_text(gate_report(rows, n, list(e.cycles)), self.at.document("report.md"))
        return out

    def stages(self) -> list[runner.Stage]:
        return [
            runner.Stage("reproject", "area and points in metres, and their report", self.reproject),
            runner.Stage("mosaics", "each cycle's source tiles on one grid", self.build_mosaics),
            runner.Stage("index", "the chip index", self.build_index),
            runner.Stage("embed", "cells that are stale", self.embed),
            runner.Stage("load", "cells into the store", self.load),
            runner.Stage("evaluate", "metrics, results and the report", self.evaluate),
        ]

    def run(self, **picked) -> dict[str, object]:
        return runner.run(runner.pick(self.stages(), **picked))

    def passes(self) -> bool:
        """Whether the gate says GO or ITERATE on the results as they are."""
        rows = self.metrics().filter("variant = 'findable'").drop("variant")
        _, chips, _ = self.index()
        n = chips.filter(F.col("cycle") == self.experiment.cycles[0]).count()
        base = evaluation.random_baseline(evaluation.findable_concepts(rows), n).filter("k = 10").agg(F.coalesce(F.avg("hit"), F.lit(0.0))).first()[0]
        return evaluation.gate(rows, base).first()["verdict"] != "KILL candidate"


def swap(make: Callable[[str], Run], old: str, new: str, accept: Callable[[Run], bool] = Run.passes) -> bool:
    """Embed, load and evaluate under a new model, and delete the old one's rows if it is accepted; else the new one's go again."""
    run = make(new)

    def purge(model: str) -> None:
        store.delete(run.spark, run.at.store, model, run.experiment.bands, run.experiment.experiment_id)

    passed = runner.swap_model(old, new, lambda _: run.run(first="index", last="load"), lambda _: accept(run), purge)
    if not passed:
        purge(new)
    return passed


def geo_buffer(bounds: tuple[float, float, float, float], by: float = 250.0) -> tuple[float, float, float, float]:
    """Whole metres around bounds, as ``geo.buffered`` gives them for rows."""
    w, s, e, n = bounds
    return np.floor(w - by), np.floor(s - by), np.ceil(e + by), np.ceil(n + by)


def encoded(windows: DataFrame, bands: list[int], model_id: str) -> DataFrame:
    """chip_id, embedding (float32, unit norm) of windows (chip_id, band, height, width, data): the bands of a chip meet in one task."""
    loader, _ = encoders.encoder(model_id)

    def run(key, table):
        by = {b: i for i, b in enumerate(table.column("band").to_pylist())}
        h, w = table.column("height")[0].as_py(), table.column("width")[0].as_py()
        none = np.zeros((h, w), np.uint8)
        planes = [np.frombuffer(table.column("data")[by[b]].as_py(), "<u2").reshape(h, w).clip(0, 255).astype(np.uint8) if b in by else none for b in bands]
        v = loader().images([np.stack(planes)])[0].astype(np.float32)
        return pa.table([[key[0].as_py()], pa.array([v], pa.list_(pa.float32()))], names=["chip_id", "embedding"])

    return windows.groupBy("chip_id").applyInArrow(run, "chip_id string, embedding array<float>")


def area_document(spark: SparkSession, at: Folders, aoi_id: str) -> dict:
    """The area of interest in degrees as a service answers it; a missing document is an error."""
    value = read_text(at.area(aoi_id, False))
    if value is None:
        raise FileNotFoundError(at.area(aoi_id, False))
    return {"aoi_id": aoi_id, "geojson": json.loads(value)}


def crs_report(rings: DataFrame, points: DataFrame, aoi_id: str, eval_set_id: str, tolerance: float = 1e-7) -> str:
    """How far vertices and points are off after metres and back; over ``tolerance`` degrees is an error."""
    vertices = rings.select(F.lit("vertex").alias("kind"), F.explode("points").alias("p")).select("kind", "p.x", "p.y")
    both = vertices.unionByName(points.select(F.lit("point").alias("kind"), "x", "y"))
    mx, my = geo.to_utm(F.col("x"), F.col("y"))
    there = both.withColumns({"mx": mx, "my": my})
    lon, lat = geo.to_degrees(F.col("mx"), F.col("my"))
    off = F.greatest(F.abs(lon - F.col("x")), F.abs(lat - F.col("y")))
    outer = F.col("kind") == "vertex"
    edge = lambda f, c: f(F.when(outer, F.col(c)))
    r = there.agg(F.max(off).alias("off"), F.count_if(outer).alias("vertices"), F.count_if(~outer).alias("points"), *[edge(f, c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y", "mx", "my")]).first()
    size = areas.size_of(rings.withColumn("points", areas.rings_to_utm(F.col("points")))).agg(F.sum("area")).first()[0] or 0.0
    if r["off"] is not None and r["off"] > tolerance:
        raise ValueError(f"coordinates come back {r['off']:.2e} degrees off")
    box = lambda x, y: ", ".join(f"{r[f'{n}_{c}']:.6f}" for n in ("low", "high") for c in (x, y))
    return "\n".join([
        f"area {aoi_id}, points {eval_set_id}, EPSG:26916", f"area of use (west, south, east, north): {', '.join(map(str, geo.AREA_OF_USE))}", f"bounds in degrees: {box('x', 'y')}", f"bounds in metres: {box('mx', 'my')}",
        f"size: {size:.3f} square metres", f"there and back over {r['vertices']} vertices and {r['points']} points: {r['off'] or 0:.2e} degrees at most, {tolerance:g} allowed",
    ]) + "\n"
