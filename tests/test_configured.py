"""An inversion from settings, from tables to states, and the readers of footprints."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline import api, invert
from plumeline.functions import timing
from plumeline.functions.timeaxis import axis, step
from plumeline.operators import flux, prior
from plumeline.operators.grid import Grid
from plumeline.plans import configured, inversion
from plumeline.sources import config, footprints

GRID = {"lon0": 0, "lat0": 40, "dlon": 1, "dlat": 1, "nlon": 4, "nlat": 4}
DAY = datetime.datetime(2018, 1, 1)


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    """Two weeks of daily fluxes, one category of which is optimised, a combination, and observations made by twice the prior."""
    folder = tmp_path_factory.mktemp("configured")
    rng = np.random.default_rng(0)
    times = [DAY + datetime.timedelta(days=k) for k in range(-3, 24)]
    cells = [(t, j, i) for t in times for j in range(4) for i in range(4)]
    bio = [(t, j, i, float(rng.uniform(1, 3))) for t, j, i in cells]
    schema = "time timestamp, ilat int, ilon int, flux double"
    year = lambda rows, y: [r for r in rows if r[0].year == y]
    spark.createDataFrame(year(bio, 2018), schema).write.parquet(f"{folder}/flux/D/co2.bio.2018-01.parquet")
    spark.createDataFrame(year(bio, 2017), schema).write.parquet(f"{folder}/flux/D/co2.bio.2017.parquet")
    monthly = [(datetime.datetime(y, m, 1), j, i, 1.0) for y, m in ((2017, 12), (2018, 1)) for j in range(4) for i in range(4)]
    spark.createDataFrame(monthly, schema).write.parquet(f"{folder}/flux/MS/co2.fossil.parquet")
    obs, fp = [], []
    value = {r[:3]: r[3] for r in bio}
    for n in range(150):
        t = DAY + datetime.timedelta(days=int(rng.integers(1, 14)))
        total = 0.0
        for _ in range(8):
            back, j, i, s = int(rng.integers(0, 3)), int(rng.integers(4)), int(rng.integers(4)), float(rng.uniform(0.1, 1))
            at = t - datetime.timedelta(days=back)
            fp.append((n, (at - DAY).days, j, i, s))
            total += s * (2 * value[at, j, i] + 1.0)
        obs.append((n, t, "co2", total, 0.05, 0.0))
    spark.createDataFrame(obs, "obsid long, time timestamp, tracer string, obs double, err_obs double, mix_background double").write.parquet(f"{folder}/obs")
    spark.createDataFrame(fp, "obsid long, itim int, ilat int, ilon int, sensi double").groupBy("obsid", "itim", "ilat", "ilon").agg(F.sum("sensi").alias("sensi")).write.parquet(f"{folder}/fp")
    return {
        "here": {"root": str(folder)},
        "run": {"start": "2018-01-01", "end": "2018-01-15", "spinup": "2D", "spindown": "1D", "tag": "test", "paths": {"output": "${machine.root}/out"}, "optimizer": {"iterations": 12, "reduction": 1e3}},
        "observations": {"file": "${machine.root}/obs", "uncertainties": {"err_min": 0.1}},
        "emissions": {"tracers": ["co2"], "co2": {"region": GRID, "interval": "D", "path": "${machine.root}/flux", "prefix": "co2.", "categories": {"bio": "bio", "fossil": {"origin": "fossil", "resample_from": "MS"}}}},
        "optimize": {"emissions": {"co2": {"bio": {"optimization_interval": "7D", "cover": True, "npoints": 4, "spatial_correlation": "100-e", "temporal_correlation": "7D", "annual_uncertainty": "1 PgC", "apply_lsm": False}}}},
        "model": {"footprints": "${machine.root}/fp", "reader": "parquet", "origin": "2018-01-01"},
    }


def test_fluxes_from_settings(spark, settings):
    got = configured.fluxes(spark, config.resolved(settings, "here"), "2017-12-30", "2018-01-16")["co2"]
    assert got.flux.groupBy("category").count().orderBy("category").collect() == [("bio", 17 * 16), ("fossil", 17 * 16)]
    assert [(c.name, c.optimised) for c in got.categories] == [("bio", True), ("fossil", False)]
    assert got.flux.filter("category = 'fossil'").agg(F.sum("flux")).first()[0] == 17 * 16


def test_files_of_another_frequency(spark, settings):
    times = axis(spark, "2018-01-01", "2018-01-05", step("2D"))
    folder = config.resolved(settings, "here")["emissions"]["co2"]["path"]
    rows = configured.preprocessed(spark, f"{folder}/D", "co2.bio.", times, step("2D"))
    with pytest.raises(Exception, match="has another frequency"):
        rows.collect()


def test_months_of_a_period():
    assert configured.months_of("2017-12-30", "2018-03-01") == ["2017-12", "2018-01", "2018-02"]
    assert configured.months_of("2018-01-01", "2018-01-01") == []


def test_checks_run_with_the_rows(spark):
    """Plans with checks are made without a job; the first bad row breaks their computation, whatever is asked of them."""
    from plumeline.functions.checks import checked
    from plumeline.operators import observations

    files = spark.createDataFrame([("f", "a", 1, 2, 9), ("f", "b", 1, 2, 9)], "folder string, file string, modified int, header int, done int")
    packed = spark.createDataFrame([("x", DAY + datetime.timedelta(minutes=5), [1.0], [41.0], [7.0], [0, 1])], "obsid string, time timestamp, lon array<double>, lat array<double>, val array<double>, indptr array<int>")
    grid = Grid.of(**GRID)
    some = spark.createDataFrame([("here",)], "name string")
    obs = spark.createDataFrame([("there", 1)], "footprint string, n int")
    spark.sparkContext.setJobGroup("plans", "plans")
    plans = {
        "exactly one file": footprints.finished(files),
        "whole steps": footprints.CompressedFootprints(packed, grid, 3600).align(grid, 3600, DAY).rows(),
        "no footprint file": observations.only_existing(obs, some, "footprint", "name", required=True).select("n"),
        "odd": checked(spark.range(3).select("id"), F.col("id") < 2, "odd"),
    }
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    for message, rows in plans.items():
        with pytest.raises(Exception, match=message):
            rows.collect()
    spark.sparkContext.setJobGroup("rest", "rest")
    nulls = spark.createDataFrame([(None,), (1,)], "x int")
    assert checked(nulls, F.col("x") > 0, "never").count() == 2


def test_inversion_from_settings(spark, settings, tmp_path, monkeypatch):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(settings))
    monkeypatch.setattr(invert, "session", lambda: spark)
    level = spark.sparkContext.setLogLevel
    assert invert.main([str(path), "-m", "here", "-v", "ERROR"]) == 0
    level("ERROR")
    out = f"{settings['here']['root']}/out/test/20180101-20180115"
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    cost = lambda rows: rows.select(((F.col("mismatch") / F.col("sigma")) ** 2).alias("c")).agg(F.sum("c")).first()[0]
    before = read("apri").select((F.col("mix") - F.col("obs")).alias("mismatch"), F.col("err_obs").alias("sigma"))
    assert cost(read("apos")) < cost(before) / 10
    states = read("states").collect()
    assert len(states) == 3 * 4 and {r["category"] for r in states} == {"bio"}
    seen = [r for r in states if r["itime"] < 2]
    assert sum(r["state"] for r in seen) > 0 and all(r["sigma_apos"] < r["sigma_apri"] for r in seen)
    assert 0 < read("eigenvectors").count() <= 12
    fluxes = read("fluxes").agg(F.sum("apri").alias("apri"), F.sum("apos").alias("apos"), F.count("*").alias("n")).first()
    assert fluxes["apos"] - fluxes["apri"] == pytest.approx(sum(r["state"] for r in states)) and fluxes["apos"] > 1.2 * fluxes["apri"] > 0
    budgets = read("budgets").groupBy("year", "month").agg(F.sum("apri").alias("apri"), F.sum("apos").alias("apos")).orderBy("year").collect()
    assert [(r["year"], r["month"]) for r in budgets] == [(2017, 12), (2018, 1)]
    assert sum(r["apos"] for r in budgets) == pytest.approx(fluxes["apos"]) and sum(r["apri"] for r in budgets) == pytest.approx(fluxes["apri"])
    points = read("history").count()

    def transported(self, w):
        raise AssertionError("the history has this point")

    monkeypatch.setattr(inversion.Inversion, "gradient", transported)
    assert invert.main([str(path), "-m", "here", "-v", "ERROR"]) == 0  # broken off at the end: nothing is run again
    assert read("history").count() == points


def test_inversion_by_buckets(spark, settings):
    """Written by buckets, H gives the same states, and is gone afterwards."""
    states = {}
    for tag, buckets in (("plain", None), ("buckets", 3)):
        own = {**settings, "run": {**settings["run"], "tag": tag, "buckets": buckets}}
        states[tag] = {(r["itime"], r["ipos"]): (r["state"], r["sigma_apos"]) for r in configured.solve(spark, config.resolved(own, "here")).collect()}
    assert states["plain"].keys() == states["buckets"].keys() and len(states["plain"]) == 12
    for k, v in states["plain"].items():
        assert v == pytest.approx(states["buckets"][k], rel=1e-5, abs=1e-8)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_controls_of_several_categories():
    rng = np.random.default_rng(1)
    blocks = [inversion.Control(rng.random((t, p)), rng.random((t, t)), rng.random((p, p))) for t, p in ((2, 3), (4, 2))]
    both = configured.Controls(blocks)
    assert both.shape == (6, 3)
    w, g = rng.random(18), rng.random((6, 3))
    assert (both.to_state(w) * g).sum() == pytest.approx((w * both.to_control(g)).sum())
    assert (both.to_state(w)[2:, 2] == 0).all()


def test_footprints_of_three_layouts(spark):
    grid, hour = Grid.of(**GRID), 3600
    origin = datetime.datetime(2018, 1, 2)
    rows = spark.createDataFrame([("a", 5, 1, 1, 1.0, "s m3 kg-1", origin + datetime.timedelta(hours=5)), ("a", 4, 1, 1, 2.0, "s m3 kg-1", origin + datetime.timedelta(hours=5))], "obsid string, itim int, ilat int, ilon int, sensi double, units string, release_end timestamp")
    own = footprints.Footprints(rows, grid, hour, origin)
    got = [tuple(r) for r in own.align(grid, hour, DAY).rows().collect()]
    assert [g[:4] for g in got] == [("a", 28, 1, 1)] and got[0][4] == pytest.approx(3 * 0.0002897)
    with pytest.raises(ValueError):
        own.align(Grid.of(**GRID | {"nlon": 5}), hour, DAY)
    with pytest.raises(ValueError):
        own.align(grid, 2 * hour, DAY)
    with pytest.raises(ValueError):
        own.align(grid, hour, DAY + datetime.timedelta(minutes=30))
    packed = spark.createDataFrame([("x", origin, [1.0, 9.0], [41.0, 41.0], [7.0, 8.0], [0, 1, 2])], "obsid string, time timestamp, lon array<double>, lat array<double>, val array<double>, indptr array<int>")
    read = footprints.CompressedFootprints(packed, grid, hour).align(grid, hour, DAY)
    assert [tuple(r) for r in read.rows().collect()] == [("x", 24, 1, 1, 7.0)]
    dense = spark.createDataFrame([("d", 3, 2, [0.0, 4.0, 0.0, 0.0])], "obsid string, itim int, ilat int, values array<double>")
    assert [tuple(r) for r in footprints.DenseFootprints(dense, grid, hour, DAY).align(grid, hour, DAY).rows().collect()] == [("d", 3, 2, 1, 4.0)]
    with pytest.raises(ValueError):
        footprints.reader("netcdf")


def test_the_file_that_a_run_finished(spark):
    rows = [("f", "old", 1, 2, 9), ("f", "new", 5, 2, 9), ("g", "only", 0, 2, 1)]
    schema = "folder string, file string, modified int, header int, done int"
    assert sorted(r["file"] for r in footprints.finished(spark.createDataFrame(rows, schema)).collect()) == ["new", "only"]
    with pytest.raises(Exception, match="f has not exactly one file"):
        footprints.finished(spark.createDataFrame([*rows, ("f", "newer", 6, 2, 9)], schema)).collect()


def test_settings_of_times_grids_and_the_environment(monkeypatch):
    monkeypatch.setenv("PLACE", "there")
    got = config.resolved({"domain": GRID, "run": {"start": "${ts:2018-01-05}", "grid": "${Grid:domain}", "where": "${env:PLACE}"}})["run"]
    assert got == {"start": datetime.datetime(2018, 1, 5), "grid": Grid.of(**GRID), "where": "there"}


def test_cubes_written_and_read(spark, tmp_path):
    grid = Grid.of(**GRID)
    rows = spark.createDataFrame([("co2", "a", 1, 2, 3, 5.0), ("co2", "b", 0, 0, 1, 7.0), ("ch4", "a", 0, 0, 0, 1.0)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    times = axis(spark, "2018-01-01", "2018-01-03", step("D"))
    known = (api.Category("a", "co2", optimised=True, target=2.0), api.Category("b", "co2", transported=False), api.Category("a", "ch4"))
    cube = api.Fluxes(rows, api.cells_of(spark, grid), times, known)
    cube.write(str(tmp_path / "all"))
    back = api.Fluxes.read(spark, str(tmp_path / "all"), ["co2"])
    assert sorted(back.categories, key=lambda c: c.name) == list(known[:2]) and back.flux.count() == 2 and back.cells.count() == 16 and back.times.count() == 2
    cube.write(str(tmp_path / "some"), only_transported=True)
    assert {(r["tracer"], r["category"]) for r in api.Fluxes.read(spark, str(tmp_path / "some")).flux.collect()} == {("co2", "a"), ("ch4", "a")}
    assert cube.as_vector("a").orderBy("k").collect() == [("ch4", 0, 1.0), ("co2", 1 * 16 + 2 * 4 + 3, 5.0)]


def test_steps_and_correlation_times():
    assert flux.steps_within(step("3h"), step("h")) == 3 and prior.temporal_length("14D", "7D") == 2
    with pytest.raises(ValueError):
        flux.steps_within(step("3h"), step("2h"))
    with pytest.raises(ValueError):
        prior.temporal_length("MS", "7D")


def test_prior_is_saved_by_category(spark, settings):
    rows = spark.read.parquet(f"{settings['here']['root']}/out/test/20180101-20180115/prior")
    assert rows.count() == 12 and {"sigma", "lat", "lon", "t0", "tracer", "category"} <= set(rows.columns)


def test_times_are_logged(caplog):
    with caplog.at_level("DEBUG", logger="plumeline"):
        assert timing.timed(lambda x: x + 1)(2) == 3
    assert "took" in caplog.text
