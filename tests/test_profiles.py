"""Exact quantiles and layer profiles on odd tables."""

import math
import random

import numpy as np
import pytest

from basinsift.operators import profiles, quantiles

FEATURE = "source_path string, feature_id long, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>, attributes map<string,string>, crs string, error string"


@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_quantiles_equal_those_of_sorted_values(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(bins)
    values = [rng.choice([rng.gauss(0, 1), 5.0, 5.0, rng.uniform(-1e6, 1e6), 1e300 * rng.random() if bins > 7 else 3.0, -1e300 if bins > 7 else -2.0, 5e-324]) for _ in range(3000)]
    odd = [None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in [*values, *odd]], "v double").repartition(3)
    shares = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    if bins == 2:
        df, values, shares = df.filter("abs(v) < 10"), [v for v in values if abs(v) < 10], [0.0, 0.5, 1.0]
    for got, want in zip(quantiles.exact(df, "v", shares), np.quantile(np.array(values), shares), strict=True):
        assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


def test_quantiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(7,)] * 5, "v int")
    assert quantiles.exact(df, "v", [0.0, 0.4, 1.0]) == [7.0, 7.0, 7.0]
    assert quantiles.exact(df.limit(0), "v", [0.5]) == [None]
    assert quantiles.at_ranks(spark.range(100_001).selectExpr("id * id AS v"), "v", [0, 50_000, 100_000]) == {0: 0.0, 50_000: 2.5e9, 100_000: 1e10}


def test_layer_profile_of_odd_layers(spark):
    point = ("Point", [[(1.0, 2.0)]])
    rows = [
        ("a.shp", 0, point, {"n": "1", "x": "1.5"}, "EPSG:1", None), ("a.shp", 1, ("LineString", [[(0.0, -3.0), (9.0, 4.0)]]), {"n": " 22 ", "x": "-3e2", "extra": None}, "EPSG:1", None),
        ("a.shp", 2, None, {"n": None, "x": "oops"}, "EPSG:2", None), ("b.shp", None, None, None, None, "ValueError: cut"), ("b.shp", 0, point, {}, None, None),
        ("c.shp", None, None, None, None, "OSError: none"), (None, 5, ("Polygon", []), None, None, None),
    ]
    got = {r["source_path"]: r for r in profiles.layer_profile(spark.createDataFrame(rows, FEATURE).repartition(3)).collect()}
    a = got["a.shp"]
    assert (a["n_features"], a["geometry_types"], a["crs"], a["n_null_geometry"], a["status"]) == (3, ["LineString", "Point"], ["EPSG:1", "EPSG:2"], 1, "ok")
    assert [tuple(c) for c in a["columns"]] == [("extra", "object", 3), ("n", "int64", 1), ("x", "object", 0)] and tuple(a["bounds"]) == (0.0, -3.0, 9.0, 4.0)
    assert (got["b.shp"]["n_features"], got["b.shp"]["status"], got["b.shp"]["error"], got["b.shp"]["columns"]) == (1, "error", "ValueError: cut", [])
    assert (got["c.shp"]["n_features"], got["c.shp"]["geometry_types"], got["c.shp"]["error"]) == (0, [], "OSError: none")
    assert got[None]["n_features"] == 1 and got[None]["geometry_types"] == ["Polygon"] and got[None]["bounds"]["minx"] is None
    assert profiles.layer_profile(spark.createDataFrame([], FEATURE)).count() == 0


def test_a_row_is_counted_once_in_a_round_however_many_ranks(spark, monkeypatch):
    plans, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().toString()) or collect(df))
    df = spark.range(50_001).selectExpr("id * id AS v")
    ranks = range(0, 50_001, 2500)
    assert quantiles.at_ranks(df, "v", list(ranks)) == {k: float(k * k) for k in ranks}
    assert len(plans) > 1 and not any("Generate" in p for p in plans)
