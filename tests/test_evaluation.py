"""Metrics, closed forms, roll-ups, verdict, report."""

import math

import pytest
from placelens.functions import stats
from placelens.operators import catalog, evaluation as E, pixels
from placelens.plans.report import gate_report
from pyspark.sql import functions as F


def hits(spark, rows):
    return spark.createDataFrame(rows, "config string, concept string, chip_location_id string, rank int")


def truth(spark, rows):
    return spark.createDataFrame(rows, "concept string, chip_location_id string")


def test_perfect_and_empty_truth(spark):
    h = hits(spark, [("c", "a", f"p{i}", i + 1) for i in range(10)] + [("c", "b", f"p{i}", i + 1) for i in range(5)])
    got = {(r["concept"], r["k"]): r for r in E.metrics(h, truth(spark, [("a", "p0")])).collect()}
    assert [k for c, k in got if c == "a"] and set(got) == {("a", 1), ("a", 5), ("a", 10), ("b", 1), ("b", 5)}  # no k beyond the list
    assert (got["a", 1]["hit"], got["a", 1]["recall"], got["a", 1]["mrr"], got["a", 1]["n_gt"]) == (1, 1, 1, 1)
    assert (got["b", 5]["hit"], got["b", 5]["recall"], got["b", 5]["mrr"], got["b", 5]["n_gt"]) == (0, 0, 0, 0)


def test_partial(spark):
    h = hits(spark, [("c", "a", f"p{i}", i + 1) for i in range(10)])
    got = {r["k"]: r for r in E.metrics(h, truth(spark, [("a", "p2"), ("a", "p8"), ("a", "zz"), ("a", "yy")])).collect()}
    assert got[1]["hit"] == 0 and got[5]["recall"] == 0.25 and got[10]["recall"] == 0.5 and got[5]["mrr"] == pytest.approx(1 / 3)


def test_missing_k_as_zero_or_absent(spark):
    h = hits(spark, [("c", "a", f"p{i}", i + 1) for i in range(20)] + [("c", "b", f"p{i}", i + 1) for i in range(10)])
    t = E.metrics(h, truth(spark, [("a", "p0"), ("b", "p0")]))
    zero = {r["k"]: r["hit"] for r in E.roll_up(t, ["config"], missing_as_zero=True).collect()}
    absent = {r["k"]: r["hit"] for r in E.roll_up(t, ["config"]).collect()}
    assert zero[20] == 0.5 and absent[20] == 1.0 and zero[10] == absent[10] == 1.0


def closed(spark, n, g, k):
    c = [F.lit(v).cast("long") for v in (n, g, k)]
    return spark.range(1).select(stats.random_hit(*c), stats.random_recall(*c), stats.random_mrr(c[0], c[1])).first()


@pytest.mark.parametrize(("n", "g", "k"), [(2209, 4, 10), (100, 5, 20), (10, 8, 5), (7, 7, 3), (5, 1, 9), (30, 0, 3)])
def test_closed_forms(spark, n, g, k):
    hit, recall, mrr = closed(spark, n, g, k)
    want = 0 if g == 0 else 1 if k >= n or k > n - g else 1 - math.comb(n - g, k) / math.comb(n, k)
    assert hit == pytest.approx(want, abs=1e-12) and recall == pytest.approx(min(k, n) / n if g else 0)
    assert mrr == pytest.approx(sum(math.comb(n - j, g - 1) / math.comb(n, g) / j for j in range(1, n - g + 2)) if g else 0, abs=1e-10)


def test_closed_forms_golden_and_sampled(spark):
    hit, _, mrr = closed(spark, 2209, 4, 10)
    assert round(hit, 6) == 0.017997 and round(mrr, 7) == 0.0116852
    sizes = spark.createDataFrame([("few", 5), ("none", 0), ("all", 100)], "concept string, n_gt int")
    got = {s["concept"]: s for s in E.random_sampled(sizes, 100, 10, 3000).collect()}
    h, r, m = closed(spark, 100, 5, 10)
    s = got["few"]
    assert abs(s["hit"] - h) < 0.03 and abs(s["recall"] - r) < 0.01 and abs(s["mrr"] - m) < 0.01
    assert tuple(got["none"])[1:] == (0, 0, 0) and tuple(got["all"])[1:] == pytest.approx((1, 0.1, 1))
    assert E.random_sampled(sizes.repartition(3), 100, 10, 50).exceptAll(E.random_sampled(sizes, 100, 10, 50)).isEmpty()


@pytest.mark.parametrize("skew", [1.0, 40.0])
def test_percentiles_by_ranges(spark, monkeypatch, skew):
    """Equal to interpolation between neighbours in order, however values spread, with few bins a round."""
    import numpy as np

    monkeypatch.setattr(pixels, "BINS", 8)
    rng = np.random.default_rng(4)
    groups = {"one": [3.0], "two": [1.0, 2.0], "same": [5.0] * 40, "wide": np.exp(rng.normal(0, skew, 700)).tolist(), "signed": (rng.normal(0, 1, 400) * 1e200).tolist(), "ties": rng.integers(0, 9, 500).astype(float).tolist()}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("ties", None), ("ties", float("nan")), ("ties", float("inf")), ("none", None)]
    shares = [0.0, 0.02, 0.37, 0.5, 0.98, 1.0]
    got = {r["k"]: r["p"] for r in pixels.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], shares, "v").collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.percentile(v, [100 * p for p in shares]).tolist(), rel=1e-12)


def gate_rows(spark, good):
    rows = [("m__rgb", c, 4, k, float(i < good), 0.1, float(i < good)) for i, c in enumerate(("waterfall", "dam", "road", "pond")) for k in (1, 5, 10, 20)]
    return spark.createDataFrame([*rows, ("m__rgb", "cemetery", 0, 10, 0.0, 0.0, 0.0)], "config string, concept string, n_gt long, k int, hit double, recall double, mrr double")


def test_gate(spark):
    verdict = lambda n: E.gate(gate_rows(spark, n), 0.02).first()
    assert verdict(4)["verdict"] == "GO" and verdict(3)["verdict"] == "GO"  # round half to even: 0.7 * 4 = 2.8 -> 3
    assert verdict(1)["verdict"] == "ITERATE" and verdict(0)["verdict"] == "KILL candidate"
    assert verdict(4)["n_findable"] == 4


def test_gate_edges(spark):
    rows = gate_rows(spark, 4)
    assert tuple(E.gate(rows.filter("false"), 0.02).select("n_hit10", "n_findable", "n_passed", "verdict").first()) == (0, 0, 2, "KILL candidate")
    assert E.gate(rows.withColumn("n_gt", F.lit(0)), 0.02).first()["n_findable"] == 0
    only = E.gate(rows.filter("k <> 10 OR concept = 'dam'"), 0.02).first()  # a list too short for k = 10 counts as a miss
    assert (only["n_hit10"], only["n_findable"], only["verdict"]) == (1, 4, "ITERATE")


def test_gate_reads_its_table_once(spark):
    from placelens.queries import QUERIES

    plan = QUERIES["gate_verdict"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 20


def test_roll_up_counts_missing_as_zero(spark):
    rows = spark.createDataFrame([("c", "a", 1, 1.0, 0.5, 1.0), ("c", "a", 5, 1.0, 1.0, 1.0), ("c", "b", 1, 0.0, 0.0, 0.5)], "config string, concept string, k int, hit double, recall double, mrr double")
    got = {r["k"]: (r["hit"], r["recall"], r["mrr"]) for r in E.roll_up(rows, ["config"], (1, 5, 10), missing_as_zero=True).collect()}
    assert got == {1: (0.5, 0.25, 0.75), 5: (0.5, 0.5, 0.75), 10: (0.0, 0.0, 0.75)}
    assert {r["k"]: r["hit"] for r in E.roll_up(rows, ["config"], (1, 5, 10)).collect()} == {1: 0.5, 5: 1.0}


def test_floor_configs(spark):
    df = spark.createDataFrame([("clip-vit-b-32-openai__rgb",), ("x__rgb",), ("ensemble:clip-vit-b-32-openai+x__rgb",), ("ensemble:clip-vit-b-32-openai__rgb",)], "c string")
    got = [(r[0], r[1]) for r in df.select(E.is_floor(F.col("c")), E.is_not_floor(F.col("c"))).collect()]
    assert got == [(True, False), (False, True), (False, True), (False, False)]


def test_report(spark):
    t = gate_rows(spark, 3)
    both = t.withColumn("variant", F.lit("findable")).unionByName(t.withColumn("variant", F.lit("strict")))
    text = gate_report(both, 2209, ["2018", "2020"])
    assert all(f"## {s}." in text for s in "ABCDEF") and "GO" in text and "m / rgb" in text


def test_winter_pick_and_zero_cloud(spark):
    rows = [(1, "2019-12-10 00:00:00", 5.0), (2, "2020-02-01 00:00:00", 0.0), (3, "2021-01-01 00:00:00", None), (4, "2021-02-01 00:00:00", 7.0)]
    items = spark.createDataFrame(rows, "item_id long, ts string, cloud_cover double").withColumn("ts", F.to_timestamp("ts"))
    pick = lambda **o: {r["winter"]: r["item_id"] for r in catalog.clearest_per_winter(items, 5, **o).collect()}
    assert pick() == {2020: 2, 2021: 4} and pick(zero_is_missing=True) == {2020: 1, 2021: 4}
    assert [r["winter"] for r in catalog.clearest_per_winter(items, 1).collect()] == [2021]


def test_manifest_merge_and_fetch_times(spark):
    picks = spark.createDataFrame([(1, {"a": "n"}, None), (2, {"a": "n"}, "f"), (3, {"a": "n"}, None)], "item_id int, assets map<string,string>, fetched_at string")
    prior = spark.createDataFrame([(1, {"a": "o"}, "t"), (2, {}, None)], "item_id int, assets map<string,string>, fetched_at string")
    got = {r["item_id"]: (r["assets"]["a"], r["fetched_at"]) for r in catalog.merge_manifest(picks, prior).collect()}
    assert got == {1: ("o", "t"), 2: ("n", "f"), 3: ("n", None)}
    marks = spark.createDataFrame([(1, False, "old", "file", "now"), (2, True, None, "file", "now"), (3, True, "old", "file", "now")], "i int, skipped boolean, fetched_at string, file_time string, now string")
    assert [r["fetched_at"] for r in catalog.mark_fetched(marks).orderBy("i").collect()] == ["now", "file", "old"]


def test_stretch_rules(spark):
    rows = [(1, float(v)) for v in range(101)] + [(2, 7.0)] * 5 + [(3, 0.0)] * 4
    df = spark.createDataFrame(rows, "band int, value double")
    got = {(r["band"], r["value"]): r["stretched"] for r in pixels.stretch(df, ["band"]).collect()}
    assert got[1, 0.0] == 0 and got[1, 100.0] == 255 and got[1, 50.0] == 127 and got[2, 7.0] == 7
    zero = {(r["band"], r["value"]): r["stretched"] for r in pixels.stretch(df, ["band"], skip_zeros=True).collect()}
    assert zero[2, 7.0] == 0 and zero[3, 0.0] == 0


def test_raster_checks(spark):
    meta = spark.createDataFrame([(4, "uint8", 0.6, 0.5, 0.0, 10.0, 10.0, 26916), (4, "uint16", 0.6, 0.0, 0.0, 10.0, 10.0, 26916), (4, "uint8", 0.6, 2.0, 0.0, 10.0, 10.0, 26916)], "n_bands int, dtype string, pixel double, xmin double, ymin double, xmax double, ymax double, epsg int")
    assert [r["ok"] for r in pixels.check_raster(meta, 4, "uint8", [0, 0, 10, 10]).collect()] == [True, False, False]
    assert pixels.check_epsg(meta).count() == 3
    with pytest.raises(Exception, match="working CRS"):
        pixels.check_epsg(meta.withColumn("epsg", F.lit(4326))).collect()
