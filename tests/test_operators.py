import datetime
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeline.functions import expressions, timeaxis, units
from plumeline.operators import background, clusters, footprints, grid, mapping, observations, prior, solver, transport
from plumeline.sources import config, tables


def test_units():
    assert units.conversion("umol/m2/s", "PgC") == units.Conversion(pytest.approx(1e-6 * 12.011 / 1e15), 1, 1)
    assert units.conversion("PgC", "umol/m2/s").area_power == -1
    assert units.unit("s m3 kg-1").exponents == {"time": 1, "length": 3, "mass": -1}
    assert units.is_extensive("TgCH4") and not units.is_extensive("nmol/m2/s")
    assert units.species("CO2")["mix"] == "ppm"
    for a, b in (("umol/m2/s", "kg"), ("mol/m3", "mol"), ("mol", "mol s2")):
        with pytest.raises(ValueError):
            units.conversion(a, b)
    with pytest.raises(ValueError):
        units.unit("parsec")


@given(st.dictionaries(st.sampled_from(["a", "b", "long_name", "x1"]), st.integers(-9, 9).filter(bool).map(float), min_size=1))
@settings(max_examples=50)
def test_expressions_round_trip(coefficients):
    assert expressions.terms(expressions.to_text(coefficients)) == coefficients


def test_expressions():
    assert expressions.terms("0.4*fires + waste - 1e-3*a + a*2 - -b") == {"fires": 0.4, "waste": 1.0, "a": 1.999, "b": 1.0}
    for bad in ("", "a b", "a*b", "2", "a +", "* a", "a $"):
        with pytest.raises(ValueError):
            expressions.terms(bad)


def test_steps(spark):
    assert timeaxis.step("7D") == timeaxis.Step(seconds=604800)
    assert timeaxis.step("3MS") == timeaxis.Step(months=3)
    assert (timeaxis.step("MS") * 2).ratio(timeaxis.step("MS")) == 2
    with pytest.raises(ValueError):
        timeaxis.step("Y").ratio(timeaxis.step("D"))
    rows = timeaxis.axis(spark, "2018-01-01", "2018-01-11", timeaxis.step("3D")).orderBy("itim").collect()
    assert [r["dt"] for r in rows] == [259200.0, 259200.0, 259200.0, 86400.0]


def test_rolling_means_against_plain_loops(spark):
    day = datetime.datetime(2020, 1, 1)
    rows = [(i, f"c{i % 2}", day + datetime.timedelta(hours=37 * i), float(i * i % 17), float(i % 5), [1.0, 0.0, -10.0, 2.0][i % 4]) for i in range(40)]
    obs = spark.createDataFrame(rows, "obsid int, code string, time timestamp, obs double, mix_apri double, err_obs double")
    settings_ = observations.ErrorSettings(err_min=0.5)
    got = {r["obsid"]: r["obs_rolling"] for r in observations.rolling_means(obs, settings_).collect()}
    for i, code, time, *_ in rows:
        w = [(0.5 if r[5] <= 0 and r[5] != 0 else r[5], r[3]) for r in rows if r[1] == code and time - datetime.timedelta(days=7) < r[2] <= time]
        w = [(0.5 if e == 0 else e, x) for e, x in w]
        want = sum(x / e**2 for e, x in w) / sum(1 / e**2 for e, x in w)
        assert got[i] == pytest.approx(want)


def test_rolling_means_cost_a_row_the_same_however_many_a_window_has(spark):
    """No frame slides (Spark sums each sliding frame anew); ties, missing values, edges of windows and rows without a time count as in a plain loop."""
    day = datetime.datetime(2020, 1, 1)
    times = [day + datetime.timedelta(hours=12 * (i // 3)) for i in range(180)] + [None] * 3
    rows = [(i, "a", t, None if i % 7 == 0 else float(i * i % 17), float(i % 5), [1.0, 0.0, 2.0][i % 3]) for i, t in enumerate(times)]
    obs = spark.createDataFrame(rows, "obsid int, code string, time timestamp, obs double, mix_apri double, err_obs double")
    means = observations.rolling_means(obs)
    plan = plan_of(means)
    assert plan.count("RangeFrame, unboundedpreceding") == plan.count("RangeFrame,") > 0
    got = {r["obsid"]: r["obs_rolling"] for r in means.collect()}
    assert len(got) == len(rows)
    for i, _, time, *_ in rows:
        inside = [r for r in rows if (r[2] is None if time is None else r[2] is not None and time - datetime.timedelta(days=7) < r[2] <= time)]
        w = [(e, x) for *_, x, _, e in inside if e and x is not None]
        assert got[i] == (pytest.approx(sum(x / e**2 for e, x in w) / sum(1 / e**2 for e, _ in w)) if w else None)


def test_settings_and_empty_tables(spark):
    assert observations.ErrorSettings().update(err_fac=2.0, other=1).err_fac == 2.0
    empty = spark.createDataFrame([], "obsid long, code string, time timestamp, obs double, mix_apri double, err_obs double")
    assert observations.inflated_errors(empty).count() == 0
    fp = spark.createDataFrame([], "obsid long, itim int, ilat int, ilon int, sensi double")
    flux = spark.createDataFrame([], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    assert transport.forward(empty.withColumn("tracer", F.lit("co2")), fp, flux).count() == 0


def test_observation_without_overlap_has_zero(spark):
    obs = spark.createDataFrame([(1, "co2"), (2, "co2"), (3, "ch4")], "obsid long, tracer string")
    fp = spark.createDataFrame([(1, 0, 0, 0, 2.0), (2, 9, 9, 9, 2.0)], "obsid long, itim int, ilat int, ilon int, sensi double")
    flux = spark.createDataFrame([("co2", "a", 0, 0, 0, 3.0)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    assert sorted(transport.forward(obs, fp, flux).collect()) == [(1, "a", 6.0), (2, "a", 0.0)]


def test_footprint_rules(spark):
    rows = spark.createDataFrame([("a", 5, 0, 0, 1.0), ("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 1.0), ("b", -1, 0, 0, 1.0)], "obsid string, itim int, ilat int, ilon int, sensi double")
    assert {(r["obsid"], r["itim"]) for r in footprints.trimmed(rows, 3).collect()} == {("a", 5)}
    packed = spark.createDataFrame([("x", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0], [0, 2, 2, 3])], "obsid string, lon array<double>, lat array<double>, val array<double>, indptr array<int>")
    assert sorted(tuple(r) for r in footprints.compressed_to_rows(packed).collect()) == [("x", -2, 3.0, 6.0, 9.0), ("x", 0, 1.0, 4.0, 7.0), ("x", 0, 2.0, 5.0, 8.0)]


def test_grid():
    g = grid.europe()
    assert g.shape == (160, 200) and g <= grid.global_steps(1, 1) and g < grid.global_steps(1, 1)
    assert grid.global_steps(6, 4).is_global and not g.is_cyclic
    assert g.indices(33.1, -14.9) == (0, 0)
    assert g.expanded(west=1).lon0 == -16 and g.padded(grid.Grid.of(lon0=-16, lon1=36, dlon=1, lat0=30, lat1=80, dlat=1)).extent == (-16, 36, 30, 80)
    assert grid.polar_edges(4) == [-90, -60, 0, 60, 90]
    assert grid.grid_from({"grid.lon0": 0, "grid.lon1": 10, "grid.dlon": 1, "x.lat0": 0, "x.lat1": 5, "x.dlat": 1}, "x").shape == (5, 10)
    with pytest.raises(ValueError):
        grid.Grid.of(lon0=0, lon1=1, dlon=0.3, lat0=0, lat1=1, dlat=1)


def test_regridding_keeps_mass(spark):
    source, target = grid.Grid.of(lon0=0, lon1=30, dlon=3, lat0=10, lat1=40, dlat=3), grid.Grid.of(lon0=-5, lon1=40, dlon=5, lat0=5, lat1=45, dlat=4)
    rows = source.cells(spark).select(F.lit("a").alias("k"), "ilat", "ilon", (F.col("icell") * 1.0).alias("flux"))
    out = grid.regrid(rows, source, target, ["k"])
    total = lambda d: d.agg(F.sum("flux")).first()[0]
    assert total(out) == pytest.approx(total(rows))
    flat = source.cells(spark).select(F.lit("a").alias("k"), "ilat", "ilon", F.lit(2.0).alias("flux"))
    inner = grid.Grid.of(lon0=5, lon1=25, dlon=5, lat0=12, lat1=36, dlat=6)
    assert all(r["flux"] == pytest.approx(2.0) for r in grid.regrid(flat, source, inner, ["k"], density=True).collect())


def test_axes_of_edges(spark):
    """A grid with half cells at the poles covers the sphere, and takes over what another holds."""
    lat = grid.axis_of_edges(spark, grid.polar_edges(7))
    lon = grid.axis_of_edges(spark, [-180.0, -20.0, 60.0, 180.0])
    sphere = grid.cells_of_axes(lat, lon).agg(F.sum("area")).first()[0]
    assert sphere == pytest.approx(4 * math.pi * grid.EARTH_RADIUS**2)
    source = grid.global_steps(30, 30)
    rows = source.cells(spark).select(F.lit("a").alias("k"), "ilat", "ilon", (F.col("icell") * 1.0).alias("flux"))
    out = grid.regridded(rows, grid.overlaps(source.axis(spark, "lat"), lat, "sine"), grid.overlaps(source.axis(spark, "lon"), lon), ["k"])
    assert out.agg(F.sum("flux")).first()[0] == pytest.approx(sum(range(72)))


def test_cyclic_overlap(spark):
    a = spark.createDataFrame([(0, 0.0, 10.0)], "i int, low double, high double")
    b = spark.createDataFrame([(0, 355.0, 365.0)], "i int, low double, high double")
    assert grid.overlaps(a, b, cyclic=True).collect()[0]["frac"] == 0.5


def test_mapping_is_adjoint(spark):
    axis = spark.createDataFrame([(i, 30.0 * i, 30.0 * i + 30) for i in range(12)], "i int, t0 double, t1 double")
    opt = spark.createDataFrame([(i, 70.0 * i, 70.0 * i + 70) for i in range(5)], "i int, t0 double, t1 double")
    tmap = mapping.temporal(axis, opt)
    sums = tmap.groupBy("itim_opt").agg(F.sum("frac").alias("s")).collect()
    assert len(sums) == 5 and all(r["s"] == pytest.approx(1) for r in sums)
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=5))], "itime int, state double")
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=12))], "itim_mod int, value double")
    hx, hty = mapping.over_time(x, tmap, []), mapping.over_time_adjoint(y, tmap, [])
    left = hx.join(y.withColumnRenamed("value", "y"), "itim_mod").agg(F.sum(F.col("value") * F.col("y"))).first()[0]
    right = hty.join(x.withColumnRenamed("state", "x"), "itime").agg(F.sum(F.col("state") * F.col("x"))).first()[0]
    assert left == pytest.approx(right, rel=1e-12)


@given(st.integers(1, 7), st.integers(1, 7), st.integers(1, 20), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_clusters(ny, nx, n, seed):
    rng = np.random.default_rng(seed)
    field, mask = rng.normal(size=(ny, nx)), rng.random((ny, nx)) < 0.8
    found = clusters.clusterize(field, n, mask)
    assert ((found >= 0) == mask).all()
    numbers = np.unique(found[mask])
    assert (numbers == np.arange(len(numbers))).all()
    assert len(numbers) >= min(n, mask.sum())
    for k in numbers:
        assert len(clusters.connected(np.argwhere(found == k))) == 1


def quadratic(n=12, seed=3):
    rng = np.random.default_rng(seed)
    h = rng.normal(size=(30, n))
    y, sigma = rng.normal(size=30), 0.5 + rng.random(30)
    a = np.eye(n) + h.T @ np.diag(sigma**-2) @ h
    b = h.T @ (y / sigma**2)
    return a, b, lambda w: 0.5 * w @ a @ w - b @ w, lambda w: a @ w - b


def test_minimisers_find_the_solution():
    a, b, cost, gradient = quadratic()
    want = np.linalg.solve(a, b)
    found = solver.lanczos(gradient, np.zeros(len(b)), reduction=1e12)
    assert np.allclose(found.x, want, atol=1e-8)
    assert np.allclose(found.eigenvalues, np.linalg.eigvalsh(a)[::-1][: len(found.eigenvalues)], atol=1e-6)
    found = solver.conjugate_gradient(cost, gradient, np.zeros(len(b)), 200, 1e8)
    assert np.allclose(found.x, want, atol=1e-5)
    assert abs(solver.gradient_test(cost, gradient, np.ones(len(b)))[2][1] - 1) < 1e-3


def test_posterior_is_the_inverse_hessian():
    a, b, _, gradient = quadratic()
    found = solver.lanczos(gradient, np.zeros(len(b)), reduction=1e14)
    sigma = solver.posterior_sigma(np.ones(len(b)), lambda v: v, found)
    assert np.allclose(sigma**2, np.diag(np.linalg.inv(a)), atol=1e-6)


def test_total_uncertainty_is_the_full_matrix(spark):
    rng = np.random.default_rng(1)
    sigma = rng.random((3, 4))
    ct = np.exp(-np.abs(np.subtract.outer(range(3), range(3))) / 2.0)
    ch = np.exp(-np.abs(np.subtract.outer(range(4), range(4))) / 3.0)
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, corr double")
    rows = spark.createDataFrame([(int(t), int(p), float(v)) for (t, p), v in np.ndenumerate(sigma)], "itime int, ipos int, sigma double")
    got = prior.total_uncertainty(rows, frame(ct), frame(ch)).first()["total"]
    assert got == pytest.approx(math.sqrt(sigma.ravel() @ np.kron(ct, ch) @ sigma.ravel()))


def test_roots_and_preconditioner(spark, tmp_path):
    d = np.abs(np.subtract.outer(range(6), range(6))).astype(float)
    corr = prior.ARRAY_KERNELS["e"](d, 2.0)
    for root in (prior.spatial_root(corr), prior.temporal_root(corr), prior.cached_root(corr, spark, str(tmp_path)), prior.cached_root(corr, spark, str(tmp_path))):
        assert np.allclose(root @ root.T, corr)
    rng = np.random.default_rng(2)
    lt, lh, sigma = rng.normal(size=(4, 4)), rng.normal(size=(6, 6)), rng.random((4, 6))
    w, g = rng.normal(size=(4, 6)), rng.normal(size=(4, 6))
    assert (prior.precondition(w, sigma, lt, lh) * g).sum() == pytest.approx((w * prior.precondition_adjoint(g, sigma, lt, lh)).sum())
    assert prior.kernel_and_length("500-e") == (500.0, "e")
    with pytest.raises(ValueError):
        prior.kernel_and_length("500-z")


def test_interpolation_is_clamped(spark):
    conc = spark.createDataFrame([(0, 0.0, 1.0), (1, 10.0, 3.0), (2, 20.0, 4.0)], "ilev int, height double, value double")
    ends = spark.createDataFrame([(h,) for h in (-5.0, 0.0, 5.0, 15.0, 20.0, 99.0)], "height double")
    assert [r["background"] for r in background.at_endpoints(ends, conc).orderBy("height").collect()] == [1.0, 1.0, 2.0, 3.5, 4.0, 4.0]


def test_tar_round_trip(spark, tmp_path):
    obs = spark.createDataFrame([("s1", datetime.datetime(2018, 1, 4, 3), 412.5), ("s2", datetime.datetime(2018, 1, 5), None)], "site string, time timestamp, obs double")
    sites = spark.createDataFrame([("s1", "One, two")], "site string, name string")
    path = str(tmp_path / "o.tar.gz")
    tables.observations_to_tar(obs, sites, path)
    got = tables.observations_from_tar(spark, path, "site string, time timestamp, obs double", "site string, name string")
    assert sorted(got[0].collect()) == sorted(obs.collect()) and got[1].collect() == sites.collect()


def test_flux_tables(spark, tmp_path):
    flux = spark.createDataFrame([("co2", "a", 0, 0, 0, 1.0), ("ch4", "b", 0, 0, 0, 2.0)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    tables.write_flux(flux, str(tmp_path / "f"))
    assert tables.read_flux(spark, str(tmp_path / "f"), ["ch4"]).first()["flux"] == 2.0
    plan = tables.read_flux(spark, str(tmp_path / "f"), ["ch4"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tracer" in plan
    tables.append_states(spark, str(tmp_path / "s"), 0, "x", [1, 2])
    tables.append_states(spark, str(tmp_path / "s"), 1, "x", [3, 4])
    assert tables.states(spark, str(tmp_path / "s"), before=1).count() == 1
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert tables.without_nan(nan).filter("x is null").count() == 1
    meta = {"a": True, "b": None, "c": 1.5}
    assert tables.attributes_from_text(tables.attributes_to_text(meta)) == meta


def test_files_for_months():
    names = ["f.2018-01.nc", "f.2019.nc", "f.nc"]
    assert tables.files_for_months(names, "f.", ["2018-01", "2019-05", "2019-06", "2020-01"]) == names
    with pytest.raises(FileNotFoundError):
        tables.files_for_months(["g.nc"], "f.", ["2018-01"])


def test_config(tmp_path):
    settings_ = {"machine": None, "laptop": {"cpus": 8}, "run": {"n": "${machine.cpus}", "path": "/x/${run.n}/y"}}
    got = config.resolved(settings_, "laptop", run__extra=3, run__n=None)
    assert got["run"] == {"n": 8, "path": "/x/8/y", "extra": 3}
    config.write(got, str(tmp_path / "c.json"))
    assert config.read(str(tmp_path / "c.json"))["run"]["n"] == 8
    with pytest.raises(ValueError):
        config.resolved({"a": "${b}", "b": "${a}"})


def test_command_line(spark, tmp_path):
    from plumeline import cli

    obs = spark.createDataFrame([(1, "co2", 1.0, 400.0, 2.0)], "obsid long, tracer string, obs double, mix_background double, dy double")
    fp = spark.createDataFrame([(1, 0, 0, 0, 2.0)], "obsid long, itim int, ilat int, ilon int, sensi double")
    flux = spark.createDataFrame([("co2", "a", 0, 0, 0, 3.0)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    for name, t in (("o", obs), ("f", fp), ("e", flux)):
        t.write.parquet(str(tmp_path / name))
    cli.main(["-f", "-a", "-t", "--obs", str(tmp_path / "o"), "--footprints", str(tmp_path / "f"), "--emis", str(tmp_path / "e"), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/observations")).first()["mix"] == 406.0
    assert spark.read.parquet(str(tmp_path / "out/adjoint")).first()["adj"] == 4.0


# --- neighbours, backgrounds in four axes, buckets ---


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sphere(spark, n=150, seed=3):
    rng = np.random.default_rng(seed)
    lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    spots = [(90.0, 0.0), (-90.0, 10.0), (89.9, 180.0), (0.0, 179.99), (0.0, -179.99), (0.0, 180.0), (10.0, 359.0), (10.0, -1.0), (10.0, -1.0)]
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate([*zip(lat, rng.uniform(-180, 180, n)), *spots])], "ipos int, lat double, lon double").persist()


@pytest.mark.parametrize("far", [1.0, 300.0, 2500.0, 9000.0, 30000.0])
@pytest.mark.parametrize("stretch", [1.0, 2.0])
def test_neighbours_are_all_near_pairs(spark, far, stretch):
    points = sphere(spark)
    found = sorted((r["i"], r["j"], r["distance"]) for r in prior.neighbours(points, far, stretch).collect())
    every = sorted((r["i"], r["j"], r["distance"]) for r in prior.distances(points, stretch).filter(F.col("distance") <= far).collect())
    assert found == every


@pytest.mark.parametrize("kind", sorted(prior.KERNELS))
def test_near_correlations(spark, kind):
    points = sphere(spark, 60)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(prior.near_correlations(points, kind, 100.0, 1e-3)) == rows(prior.spatial_correlations(prior.distances(points), kind, 100.0, 1e-3))


def test_neighbours_meet_by_cells(spark):
    plan = plan_of(prior.near_correlations(sphere(spark), "e", 30.0))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("HashJoin" in plan or "SortMergeJoin" in plan)


def test_pairs_of_neighbours_are_dealt_out(spark):
    """A small table whose positions are all in one cell near a pole has many pairs: more than one task makes them."""
    points = spark.range(400).select(F.col("id").cast("int").alias("ipos"), (F.lit(89.0) + F.col("id") / 1000).alias("lat"), (F.col("id") * 7 % 360).cast("double").alias("lon")).coalesce(1)
    near = prior.neighbours(points, 50.0)
    assert near.groupBy(F.spark_partition_id()).count().count() > 4
    assert near.count() == prior.distances(points).filter("distance <= 50").count()


def test_positions_that_look_around_are_few_rows(spark):
    """A position goes to its own cube once, and looks into those on the sphere that are near enough, once for each pair of cubes."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 3000))), rng.uniform(-180, 180, 3000)))], "ipos int, lat double, lon double")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        gateway = spark.sparkContext._gateway
        none = gateway.jvm.java.util.ArrayList
        stages = store.stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    assert prior.neighbours(points, 500.0).count() > 3000
    assert written() - before < 15 * 3000


def test_a_dense_cube_goes_into_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prior, "BLOCK", 16)
    points = sphere(spark, 50).unionByName(spark.range(1000, 1120).select(F.col("id").cast("int").alias("ipos"), (F.lit(20.0) + F.col("id") / 10000).alias("lat"), (F.col("id") / 10000).alias("lon")))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(prior.neighbours(points, 900.0)) == rows(prior.distances(points).filter("distance <= 900"))


def test_positions_that_are_nowhere_have_no_neighbours(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, float("nan"), 1.0), (3, None, 1.0), (4, 1.0, float("inf")), (None, 1.0, 1.0), (5, 1.0, 1.0)], "ipos int, lat double, lon double")
    assert sorted(tuple(r) for r in prior.neighbours(points, 500.0).collect()) == [(1, 1, 0.0), (1, 5, 0.0), (5, 5, 0.0)]


def test_stretches_of_an_uneven_axis(spark):
    places = [0.0, 1.0, 1.5, 40.0, 41.0]
    axis = spark.createDataFrame(list(enumerate(places, 5)), "index int, position double")
    asked = [-0.1, 0.0, 0.5, 1.0, 1.2, 1.5, 20.0, 40.0, 40.5, 41.0, 41.1, None]
    points = spark.createDataFrame(list(enumerate(asked)), "point int, v double")
    got = {r["point"]: (r["x_a"], r["x_b"], r["x_w"]) for r in background.between(points, axis, "v", "x").collect()}
    assert {asked[k] for k in got} == {v for v in asked if v is not None and 0 <= v <= 41}
    for k, (a, b, w) in got.items():
        assert b == a + 1 and places[a - 5] + w * (places[b - 5] - places[a - 5]) == pytest.approx(asked[k]) and 0 <= w <= 1
    single = background.between(points, axis.filter("index = 6"), "v", "x").collect()
    assert [(asked[r["point"]], r["x_a"], r["x_b"], r["x_w"]) for r in single] == [(1.0, 6, 6, 0.0)]


def test_background_in_four_axes(spark):
    """A field that is linear in all axes is met exactly, with columns of different heights and numbers of levels."""
    day = datetime.datetime(2020, 1, 1)
    field = lambda t, y, x, h: 400 + 2 * t + 3 * y - x + h / 100
    days, rows = [0, 1, 5], []
    for i, t in enumerate(days):
        for j, y in enumerate((10.0, 20.0)):
            for k, x in enumerate((0.0, 5.0, 10.0)):
                edges = [100.0 + 7 * j + n * (200 + 10 * k + 5 * i) for n in range(4)]
                for n, low in enumerate(edges):
                    middle = (low + edges[n + 1]) / 2 - edges[0] if n < 3 else 1e6
                    rows.append((i, day + datetime.timedelta(days=t), j, y, k, x, n, low, field(t, y, x, middle)))
    conc = spark.createDataFrame(rows, "itime int, time timestamp, ilat int, lat double, ilon int, lon double, ilev int, height double, value double")
    asked = [(1, 5.0, 10.0, 260.0, 0.0), (2, 2.5, 15.0, 300.0, 3.0), (3, 10.0, 20.0, 320.0, 5.0), (4, 11.0, 15.0, 300.0, 3.0), (5, 5.0, 15.0, 300.0, 5.1), (6, 0.0, 10.0, -5.0, 0.0), (7, 0.0, 10.0, 1e9, 0.0)]
    ends = spark.createDataFrame([(n, x, y, h, day + datetime.timedelta(days=t)) for n, x, y, h, t in asked], "point int, lon double, lat double, height double, time timestamp")
    got = {r["point"]: r["background"] for r in background.at_trajectory_ends(ends, conc).collect()}
    for n, x, y, h, t in asked[:3]:
        assert got[n] == pytest.approx(field(t, y, x, h), abs=1e-6)
    assert got[4] is None and got[5] is None
    assert got[6] == pytest.approx(field(0, 10, 0, 100)) and got[7] == pytest.approx(field(0, 10, 0, 500))


def test_buckets_keep_h_in_place(spark, tmp_path):
    """Neither a point's departures nor its gradient move H, and both are what they are without buckets."""
    from plumeline.plans import inversion

    rng = np.random.default_rng(5)
    n_obs, shape = 400, (3, 8)
    h = spark.createDataFrame([(o, int(t), int(p), float(rng.normal())) for o in range(n_obs) for t, p in zip(rng.integers(0, 3, 4), rng.integers(0, 8, 4))], "obsid int, itime int, ipos int, h double")
    rows = spark.createDataFrame([(o, float(rng.normal()), 0.5) for o in range(n_obs)], "obsid int, mismatch double, sigma double")
    control = inversion.Control(np.ones(shape), np.eye(3), np.eye(8))
    plain = inversion.Inversion(control, rows, h)
    w = rng.normal(size=24)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with tables.Bucketed(spark, f"{tmp_path}/h", "obsid", 4) as keep:
            kept = inversion.Inversion.bucketed(control, rows, h, keep)
            assert "Exchange hashpartitioning(obsid" not in plan_of(kept.run(w, "x"))
            pulled = plan_of(kept.pulled(w))
            assert "Exchange hashpartitioning(itime" in pulled and "Exchange hashpartitioning(obsid" not in pulled
            assert kept.gradient(w) == pytest.approx(plain.gradient(w)) and kept.cost(w) == pytest.approx(plain.cost(w))
            names = list(keep.names)
        assert not [n for n in names if spark.catalog.tableExists(n)] and not (tmp_path / "h").exists()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_months_not_asked_for_are_not_read(spark, tmp_path):
    """Unread months can't even be read; the year and the static field stand in where a month is missing."""
    from plumeline.sources import archive

    path = f"{tmp_path}/archive"
    times = timeaxis.axis(spark, "2018-01-01", "2020-01-01", timeaxis.step("MS"))
    cube = lambda c, value: times.selectExpr("'co2' as tracer", f"'{c}' as category", "cast(itim as int) as itim", "0 as ilat", "1 as ilon", f"cast({value} as double) as flux")
    archive.write(cube("a", "itim").filter("itim <> 3"), times, path)
    archive.write(cube("a", "100 + itim").unionByName(cube("b", "200 + itim")), times, path, "year")
    archive.write(cube("c", "7").filter("itim = 0"), times, path, "static")
    for f in (tmp_path / "archive" / "tracer=co2" / "year=2019").glob("*/*.parquet"):
        f.write_bytes(b"not to be read")
    asked = timeaxis.axis(spark, "2018-03-01", "2018-06-01", timeaxis.step("MS")).withColumn("itim", F.col("itim") + 2)
    got = archive.read(spark, path, asked)
    assert "dynamicpruning" in plan_of(got)
    assert sorted((r["category"], r["itim"], r["flux"]) for r in got.collect()) == [*(("a", k, v) for k, v in ((2, 2.0), (3, 103.0), (4, 4.0))), *(("b", k, 200.0 + k) for k in (2, 3, 4)), *(("c", k, 7.0) for k in (2, 3, 4))]


def test_steps_without_fluxes(spark, tmp_path):
    from plumeline.sources import archive

    path = f"{tmp_path}/archive"
    times = timeaxis.axis(spark, "2018-01-01", "2018-04-01", timeaxis.step("MS"))
    archive.write(times.filter("itim < 2").selectExpr("'co2' as tracer", "'a' as category", "itim", "0 as ilat", "0 as ilon", "1D as flux"), times, path)
    assert [(r["category"], r["itim"]) for r in archive.missing(spark, path, times).collect()] == [("a", 2)]


# --- points in polygons ---


def in_rings(x, y, rings):
    """The even-odd rule over all edges."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 <= y < y2 or y2 <= y < y1) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
    return odd


def vertices_of(spark, shapes):
    rows = [(p, k, n, float(x), float(y)) for p, rings in shapes.items() for k, ring in enumerate(rings) for n, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "polygon int, ring int, seq int, lon double, lat double")


@pytest.mark.parametrize("height", [0.3, 1.0, 50.0])
def test_points_in_polygons(spark, height):
    """Concave rings, holes, level edges, vertices at points' latitudes, and points on edges and far away."""
    from plumeline.operators import polygons

    rng = np.random.default_rng(11)
    star = [(10 + (3 if k % 2 else 8) * math.cos(k * math.pi / 7), 5 + (3 if k % 2 else 8) * math.sin(k * math.pi / 7)) for k in range(14)]
    shapes = {1: [star], 2: [[(-20, -10), (-5, -10), (-5, 0), (-20, 0)], [(-15, -7), (-10, -7), (-10, -3), (-15, -3)]], 3: [[(-30, 2), (0, 2), (0, 3.5), (-30, 3.5)], [(0, 0), (1, 1), (2, 0)]]}
    spots = [*rng.uniform([-32, -12], [20, 15], (400, 2)).tolist(), [-20, -5], [-5, -5], [-12, -10], [-12, 0], [-12, -5], [0, 1], [1, 1], [500, 0], [0, 80]]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "point int, lon double, lat double")
    got = {(r["point"], r["polygon"]) for r in polygons.inside(points, vertices_of(spark, shapes), height).collect()}
    assert got == {(k, p) for k, (x, y) in enumerate(spots) for p, rings in shapes.items() if in_rings(x, y, rings)} and got


def test_land_of_cells(spark):
    from plumeline.operators import polygons

    cells = spark.createDataFrame([(0, 0.0, 10.0, 0.0, 10.0), (1, 0.0, 10.0, 10.0, 20.0), (2, 50.0, 60.0, 0.0, 10.0)], "icell int, lat_s double, lat_n double, lon_w double, lon_e double")
    shapes = vertices_of(spark, {1: [[(0, 0), (10, 0), (10, 5), (0, 5)]], 2: [[(-1, -1), (11, -1), (11, 5), (-1, 5)]], 3: [[(0, 50), (5, 50), (5, 60), (0, 60)]]})
    got = {n: {r["icell"]: r["land_fraction"] for r in polygons.land_fractions(cells, shapes, n).collect()} for n in (1, 2, 8)}
    lower = math.sin(math.radians(5)) / math.sin(math.radians(10))
    assert got[1] == {0: 0.0, 1: 0.0, 2: 0.0}
    for n in (2, 8):
        assert got[n] == {0: pytest.approx(lower), 1: pytest.approx(0.0 if n == 2 else lower / 8), 2: pytest.approx(0.5)}
    with pytest.raises(ValueError):
        polygons.land_fractions(cells, shapes, 0)
    assert "NestedLoop" not in plan_of(polygons.inside(spark.createDataFrame([(1, 1.0, 1.0)], "point int, lon double, lat double"), shapes))


def test_parts_of_footprints_follow_the_files(spark, tmp_path, monkeypatch):
    """Footprint rows are dealt by observation into parts as many as their files are large, and nothing after that deals them anew."""
    from plumeline.sources import fixtures, shared

    root = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared.dealt, "__defaults__", (4096,))
    rows = fixtures.view(spark, root, "fx_footprint")
    folded = footprints.release_folded(rows.withColumn("at_release_end", F.col("obsid") % 2 == 0))
    assert plan_of(folded).count("Exchange hashpartitioning") == 1
    size = os.path.getsize(f"{root}/lineitem.parquet")
    assert size > 5 * 4096 and folded.rdd.getNumPartitions() == size // 4096 + 1


def test_footprints_stay_by_observation_as_sensitivity_to_the_state(spark):
    """The maps go to the footprints, and cached departures that are dealt alike meet them in every iteration without a shuffle of either."""
    from plumeline.plans import inversion
    from plumeline.sources import fixtures, shared

    root = "/root/testdata/sf0.001"
    rows, obs = fixtures.view(spark, root, "fx_footprint"), fixtures.view(spark, root, "fx_obs")
    hmap = spark.range(80).select(F.col("id").cast("int").alias("icell"), (F.col("id") % 4).cast("int").alias("ipos"), F.lit(0.05).alias("frac"))
    tmap = spark.range(120).select((F.col("id") / 3).cast("int").alias("itim_opt"), F.col("id").cast("int").alias("itim_mod"), F.lit(1 / 3).alias("frac"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, -1)  # as with large tables
    try:
        h = inversion.state_sensitivity(obs, rows, tmap, hmap, 10)
        assert plan_of(h).count("Exchange hashpartitioning") == 2  # the rows of the footprints, and ids of observations
        departures = obs.select("obsid", F.lit(1.0).alias("mismatch"), F.lit(2.0).alias("sigma")).repartition(shared.parts_of(rows), "obsid")
        problem = inversion.Inversion(inversion.Control(np.ones((40, 4)), np.eye(40), np.eye(4)), departures.persist(), h.persist())
        for table in (problem.departures, problem.sensitivity):
            table.count()
        made = problem.pulled(np.zeros(160))
        made.collect()
        above = plan_of(made).split("InMemoryTableScan")[0]  # the first table is one that is cached, and what follows is its own plan
        assert above.count("Exchange hashpartitioning(itime") == above.count("Exchange hashpartitioning") > 0
    finally:
        spark.conf.set(key, held)
