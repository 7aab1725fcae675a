import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline import api
from plumeline.operators import grid, mapping, observations
from plumeline.plans import inversion
from plumeline.plans.queries import Views, members, model_axis, opt_axis
from plumeline.sources.fixtures import view

DATA = "/root/testdata/sf0.001"


def test_observations(spark, tmp_path):
    whole = api.Observations(view(spark, DATA, "fx_obs"), view(spark, DATA, "fx_sites"))
    some = whole.select_times("1995-01-01", "1995-12-31").select_sites(["s01", "s02"])
    assert 0 < some.obs.count() < whole.obs.count() and some.sites.count() <= 2
    assert {"region", "lat"} <= set(some.to_table().columns)
    errors = whole.__class__(view(spark, DATA, "fx_obs_ts"), whole.sites).with_errors(err_fac=2.0)
    assert errors.settings.err_fac == 2.0 and errors.obs.filter("err is not null").count() > 0
    split = api.Observations.from_table(whole.obs.select("obsid", "site", "code", "height", "obs"))
    assert split.sites.columns == ["site", "code", "height"]


def test_fluxes(spark):
    cube = api.Fluxes(view(spark, DATA, "fx_flux"), view(spark, DATA, "fx_cell"), view(spark, DATA, "fx_time"), (api.Category("fossil", "co2"), api.Category("fires", "co2", transported=False)))
    more = cube.add(api.Category("both", "co2", combination="fossil + 0.5*fires")).add(api.Category("ocean", "co2"), 2.0).resolve()
    names = {r[0] for r in more.flux.select("category").distinct().collect()}
    assert names == {"fossil", "fires", "biosphere", "both", "ocean"}
    assert {r[0] for r in cube.transported().flux.select("category").distinct().collect()} == {"fossil"}
    total = lambda c: c.flux.agg(F.sum("flux")).first()[0]
    assert total(cube.to_extensive().to_intensive()) == pytest.approx(total(cube))
    assert total(cube.convert("umol/m2/s", "PgC").convert("PgC", "umol/m2/s")) == pytest.approx(total(cube))
    assert cube.budget("co2").filter("tracer is null").count() == 1
    assert total(cube.zeros()) == 0


def test_transform_pads_crops_and_keeps_mass(spark):
    a, b = grid.Grid.of(lon0=0, lon1=10, dlon=1, lat0=0, lat1=10, dlat=1), grid.Grid.of(lon0=-4, lon1=6, dlon=2, lat0=4, lat1=14, dlat=2)
    rows = a.cells(spark).select(F.lit("k").alias("k"), "ilat", "ilon", F.lit(1.0).alias("flux"))
    got = {(r["ilat"], r["ilon"]): r["flux"] for r in grid.transform(rows, a, b, ["k"]).collect()}
    assert got[0, 0] == 0 and got[0, 4] == pytest.approx(4.0) and got[4, 4] == 0 and sum(got.values()) == pytest.approx(36)


def test_inversion_recovers_what_made_the_observations(spark):
    """Departures made by a state and hardly any error: the state comes back, by both minimisers, with smaller errors."""
    v = Views(spark, DATA)
    maps = api.Mapping(v.cell, model_axis(v), opt_axis(v))
    maps.hmap = mapping.clusters_of(members(v))
    obs = v.obs.filter("obsid % 3 = 0")
    h = maps.sensitivity(obs, v.footprint, 10).persist()
    n_time, n_space = opt_axis(v).count(), maps.positions().count()
    truth = np.random.default_rng(0).normal(size=(n_time, n_space))
    rows = spark.createDataFrame([(int(t), int(p), float(x)) for (t, p), x in np.ndenumerate(truth)], "itime int, ipos int, x double")
    departures = h.join(rows, ["itime", "ipos"]).groupBy("obsid").agg((-F.sum(F.col("h") * F.col("x"))).alias("mismatch")).withColumn("sigma", F.lit(1e-5)).persist()
    control = api.Prior(api.Category("biosphere", "co2", horizontal="500-e", temporal=60.0), maps.positions(), n_time, 91.0).control(np.ones((n_time, n_space)))
    problem = api.Optimizer(inversion.Inversion(control, departures, h))
    state = problem.solve(iterations=12, reduction=1e3)
    before, after = problem.problem.cost(np.zeros(n_time * n_space)), problem.problem.cost(problem.found.x)
    assert after < before / 5 and state.shape == truth.shape
    sigma = problem.posterior()
    assert (sigma <= control.sigma + 1e-6).all() and sigma.min() < 0.99
    assert problem.chi2() > 0
    assert abs(problem.gradient_test()[0][1] - 1) < 1e-2


def test_protocols(spark):
    model = inversion.FootprintModel(view(spark, DATA, "fx_obs"), view(spark, DATA, "fx_footprint"))
    assert model.forward(view(spark, DATA, "fx_flux")).count() > 0
    dy = model.obs.select("obsid", F.col("obs").alias("dy"))
    assert model.adjoint(dy).count() > 0
    assert observations.ErrorSettings() == observations.ErrorSettings(err_min=0.0)
    maker = api.Transport(model.footprints)
    assert abs(maker.adjoint_test(model.obs, view(spark, DATA, "fx_flux"))) < 1e-9
