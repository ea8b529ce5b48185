"""The catalog source and its pushed filters, embedding cells with provenance, and sweeps of configurations."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens import carriers as C
from placelens.functions import vectors
from placelens.operators import catalog, evaluation, search, sweep
from placelens.sources import cells, documents
from placelens.sources import catalog as source
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, Not

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """(rows, folder) of a catalog over nine years, with items without time, box or cloud."""
    day = datetime.datetime(2012, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(f"i{k}", None if k % 29 == 0 else day + datetime.timedelta(days=k * 7, hours=k % 24), None if k % 17 == 0 else float(k * 13 % 100), *([None] * 4 if k % 23 == 0 else [k % 9 - 10.0, -5.0, 10.0 + k % 4, 5.0])) for k in range(460)]
    df = spark.createDataFrame(rows, "item_id string, ts timestamp, cloud_cover double, xmin double, ymin double, xmax double, ymax double")
    folder = str(tmp_path_factory.mktemp("catalog") / "c")
    source.write_items(df, folder, files=2)
    return df, folder


def plain(df):
    return sorted((tuple(r) for r in df.drop("year").collect()), key=repr)


def test_catalog_round_trip(spark, items):
    df, folder = items
    assert plain(source.read_items(spark, folder)) == plain(df)
    assert source.read_items(spark, f"{folder}-none").collect() == []


def test_filters_leave_the_plan_above_the_scan(spark, items):
    df, folder = items
    read = source.read_items(spark, folder)
    got = read.filter("cloud_cover < 30 AND xmin <= -4 AND xmax >= 11 AND year > 2014 AND item_id != 'i7'")
    assert plain(got) == plain(df.filter("cloud_cover < 30 AND xmin <= -4 AND xmax >= 11 AND year(ts) > 2014 AND item_id != 'i7'")) != []
    above = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line and "BatchScan" not in line]
    assert all(c not in " ".join(above) for c in ("cloud_cover", "xmin", "xmax", "year")) and "item_id" in " ".join(above)
    winter = catalog.usable_winter(read, (-3.0, -1.0, 9.0, 1.0), 50.0)
    assert plain(winter) == plain(catalog.usable_winter(df, (-3.0, -1.0, 9.0, 1.0), 50.0)) != []
    assert plain(read.filter("cloud_cover IS NULL")) == plain(df.filter("cloud_cover IS NULL"))


def test_files_of_other_years_are_not_read(items):
    _, folder = items
    when = datetime.datetime(2016, 5, 1, tzinfo=datetime.timezone.utc)

    def files(*filters):
        reader = source.CatalogReader(folder)
        left = list(reader.pushFilters(list(filters)))
        return {p.year for p in reader.partitions()}, len(left)

    everything, _ = files()
    assert everything == {0, *range(2012, 2021)}
    assert files(EqualTo(("year",), 2015)) == ({2015}, 0)
    assert files(GreaterThan(("ts",), when)) == ({*range(2016, 2021)}, 0) and files(LessThan(("ts",), when)) == ({0, *range(2012, 2017)}, 0)
    assert files(In(("year",), (2013, 2019)), Not(EqualTo(("year",), 2013))) == ({2013, 2019}, 1)
    assert files(EqualTo(("year",), 1999)) == ({0}, 0) and source.CatalogReader(folder).read(source.ItemFile("", 0)).__next__ is not None


def cell_rows(spark, n=250, seed=1, dim=8):
    v = np.random.default_rng(seed).normal(0, 1, (n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, f"chip{i}", v[i].tolist()) for i in range(n)], "position long, chip_id string, embedding array<float>").repartition(5)


FACTS = {"index_sha": "i", "weights_sha": "w", "tag": None}


def test_cells_round_trip_and_staleness(spark, tmp_path):
    folder, made = str(tmp_path / "e"), []

    def embed(cell):
        made.append(cell)
        return cell_rows(spark, seed=int(cell[2]))

    wanted = [(("m", "rgb", y), dict(FACTS)) for y in ("2018", "2020")]
    assert cells.embed_stale(spark, folder, wanted, embed) == [c for c, _ in wanted] == made
    assert cells.embed_stale(spark, folder, wanted, embed) == [] and len(made) == 2  # nothing is stale
    told = {r["source_cycle"]: r for r in cells.sidecars(spark, folder).collect()}
    assert set(told) == {"2018", "2020"} and told["2018"]["n_chips"] == 250 and told["2018"]["embed_dim"] == 8 and told["2018"]["seconds"] >= 0 and told["2018"]["chips_per_sec"] > 0 and told["2018"]["files"]
    back = cells.read_cells(spark, folder).filter("source_cycle = '2020'").select("position", "chip_id", "embedding")
    assert sorted(back.collect()) == sorted(cell_rows(spark, seed=2020).collect())
    assert told["2018"]["order_digest"] == told["2020"]["order_digest"]  # the same ids in the same order
    wanted[0][1]["index_sha"] = "other"
    assert cells.embed_stale(spark, folder, wanted, embed) == [("m", "rgb", "2018")]
    assert cells.damaged(spark, folder) == []
    victim = next((tmp_path / "e" / "cells" / "model_id=m" / "bands=rgb" / "source_cycle=2020").glob("*.parquet"))
    victim.with_name(f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes() + b"x")
    assert cells.damaged(spark, folder) == [victim.name]


@pytest.mark.parametrize(("column", "change", "fault"), [
    ("embedding", "transform(embedding, x -> cast(x * 2 AS float))", "unit norm"), ("embedding", "CASE WHEN position = 3 THEN slice(embedding, 1, 3) ELSE embedding END", "components"),
    ("position", "position + 1", "positions"), ("position", "CASE WHEN position = 5 THEN 6 ELSE position END", "positions"),
])
def test_bad_cells_are_refused(spark, tmp_path, column, change, fault):
    with pytest.raises(ValueError, match=fault):
        cells.write_cell(cell_rows(spark).withColumn(column, F.expr(change)), str(tmp_path / "e"), ("m", "rgb", "2018"), FACTS)
    assert cells.sidecars(spark, str(tmp_path / "e")).collect() == []
    with pytest.raises(ValueError, match="cannot name"):
        cells.write_cell(cell_rows(spark), str(tmp_path / "e"), ("m", "a/b", "2018"), FACTS)
    with pytest.raises(ValueError, match="no rows"):
        cells.write_cell(cell_rows(spark).filter("false"), str(tmp_path / "e"), ("m", "rgb", "2018"), FACTS)


def test_npy_round_trip(spark, tmp_path):
    rows = cell_rows(spark, 40).selectExpr("'m' AS model_id", "'rgb' AS bands", "'2018' AS source_cycle", "position", "chip_id", "embedding")
    assert cells.write_npy(rows, str(tmp_path / "npy")).collect()[0]["n"] == 40
    back = documents.read_npy(spark, str(tmp_path / "npy"))
    assert sorted(back.select("chip_id", "embedding").collect()) == sorted(rows.select("chip_id", "embedding").collect())
    assert json.loads((tmp_path / "npy" / "m__rgb__2018.json").read_text())["chip_ids"][:2] == ["chip0", "chip1"]
    with pytest.raises(Exception, match="over 10 rows"):
        cells.write_npy(rows, str(tmp_path / "npy"), most_rows=10).collect()


def test_order_over_cycles(spark):
    rows = spark.createDataFrame([("m", "rgb", str(y), i, f"r{i}") for y in (2014, 2016, 2018) for i in range(50)], "model_id string, bands string, source_cycle string, position int, chip_location_id string")
    cells.check_order(rows.repartition(7))
    swapped = rows.withColumn("position", F.when(F.col("source_cycle") == "2016", F.when(F.col("position") == 7, 8).when(F.col("position") == 8, 7).otherwise(F.col("position"))).otherwise(F.col("position")))
    with pytest.raises(ValueError, match="m/rgb/2016"):
        cells.check_order(swapped)
    with pytest.raises(ValueError, match="m/rgb/2018"):
        cells.check_order(rows.filter("source_cycle != '2018' OR position < 49"))
    assert "collect_list" not in cells.order_of_cycles(rows)._jdf.queryExecution().executedPlan().toString()


def test_sweep_equals_single_searches(spark):
    store = C.half_split(spark, SF)
    some = C.chips(spark, SF).filter("vec_id % 50 = 0").select(F.concat(F.lit("c"), "vec_id").alias("concept"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    some = spark.createDataFrame(some.collect(), some.schema)
    asked = some.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_id"), F.lit("rgb").alias("bands"), "concept", "q")
    lists = {(r["config"], r["concept"], r["rank"]): r["chip_location_id"] for r in sweep.ranked_lists(store, asked, 7).collect()}
    both = {(r["concept"], r["rank"]): (r["chip_location_id"], round(r["score"], 9)) for r in sweep.ensemble_lists(store, asked, ["a", "b"], "rgb", "a", 7).collect()}
    assert len(lists) == 2 * len(both) == 2 * 7 * some.count()
    for q in some.limit(3).collect():
        for model in ("a", "b"):
            for r in search.search(store, q["q"], search.Request(top_k=7, model_id=model)).collect():
                assert lists[f"{model}__rgb", q["concept"], r["rank"]] == r["chip_location_id"]
        for rank, r in enumerate(search.search_ensemble(store, {"a": q["q"], "b": q["q"]}, "a", search.Request(top_k=7)).collect(), 1):
            assert both[q["concept"], rank] == (r["chip_location_id"], round(r["score"], 9))
    with pytest.raises(ValueError, match="models differ"):
        sweep.ensemble_lists(store, asked, ["a"], "rgb", "a")
    none = asked.filter("false")
    assert sweep.ranked_lists(store, none).collect() == [] == sweep.place_scores(store, none).collect()
    assert evaluation.metrics(sweep.ranked_lists(store, none).drop("score"), spark.createDataFrame([], "concept string, chip_location_id string")).collect() == []
    assert vectors.check_query([1]) == [1.0]


@pytest.mark.parametrize("split, chunk", [(1, 7), (13, 5), (40, 1000), (1000, 3)])
def test_parts_of_a_file_hold_each_line_once(tmp_path, monkeypatch, split, chunk):
    monkeypatch.setattr(source, "SPLIT", split)
    monkeypatch.setattr(source, "CHUNK", chunk)
    (tmp_path / "year=2018").mkdir()
    lines = [json.dumps({"id": f"i{k} é" * (k % 4), "properties": {}}, ensure_ascii=False) for k in range(40)]
    (tmp_path / "year=2018" / "a.json").write_bytes("\n".join([*lines[:9], "", *lines[9:]]).encode() + b"\n" * (split % 2))
    reader = source.CatalogReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 1
    assert [item[0] for part in parts for item in reader.read(part)] == [json.loads(line)["id"] for line in lines]


def test_a_part_is_read_in_pieces(tmp_path):
    """A task does not hold a whole file."""
    class File:
        def __init__(self, f):
            self.f, self.most = f, 0

        def seek(self, at):
            self.f.seek(at)

        def read(self, n=-1):
            got = self.f.read(n)
            self.most = max(self.most, len(got))
            return got

    path = tmp_path / "a"
    path.write_bytes(b"x" * 99 + b"\n" + (b"y" * 99 + b"\n") * 40_000)
    with open(path, "rb") as f:
        held = File(f)
        assert sum(1 for _ in source.lines_of(held, 0, None)) == 40_001 and held.most <= source.CHUNK < 4_000_000
