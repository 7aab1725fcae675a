"""Rules that the test tables don't show."""

import datetime

import numpy as np
import pytest

from plumeline import api
from plumeline.functions.timeaxis import anchored, later, spun, step
from plumeline.operators import clusters, flux, observations, prior
from plumeline.plans import inversion
from plumeline.plans.queries import QUERIES, Views, coarse_state, roots
from plumeline.streaming import forward

DATA = "/root/testdata/sf0.001"


def test_budget_follows_the_time_axis(spark):
    """Daily steps that begin at the end of 2001."""
    times = spark.createDataFrame([(k, datetime.datetime(2001, 12, 30) + datetime.timedelta(days=k)) for k in range(4)], "itim int, t0 timestamp")
    rows = spark.createDataFrame([("co2", "a", k, 0, i, 1.0 + k) for k in range(4) for i in range(2)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    got = {(r["year"], r["month"]): r["total"] for r in flux.budget(rows, times).filter("category = 'a'").collect()}
    assert got == {(2001, 12): 6.0, (2001, None): 6.0, (2002, 1): 14.0, (2002, None): 14.0, (None, None): 20.0}


def test_clusters_balance_odd_sides():
    """A row of three: the middle goes where the halves are more alike; worked by hand."""
    assert clusters.clusterize(np.array([[1.0, 2.0, 3.0]]), 2).tolist() == [[0, 0, 1]]
    assert clusters.clusterize(np.array([[3.0, 2.0, 1.0]]), 2).tolist() == [[0, 1, 1]]
    assert clusters.clusterize(np.array([[1.0], [1.0], [1.0], [9.0], [1.0]]), 2).ravel().tolist() == [0, 0, 0, 1, 1]
    both = clusters.clusterize(np.array([[4.0, 1.0], [4.0, 1.0]]), 2)
    assert both.tolist() == [[0, 0], [1, 1]]


def test_clusters_keep_least_sides():
    """Two rows that may not be cut any more: columns are, though there are fewer of them."""
    field = np.array([[5.0, 1.0], [1.0, 1.0], [1.0, 1.0]])
    assert clusters.clusterize(field, 2).tolist() == [[0, 0], [1, 1], [1, 1]]
    assert clusters.clusterize(field, 2, least=(3, 1)).tolist() == [[0, 1], [0, 1], [0, 1]]


def test_costs_without_error_or_observations(spark):
    control = inversion.Control(np.ones((1, 1)), np.eye(1), np.eye(1))
    h = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 0, 1.0)], "obsid long, itime int, ipos int, h double")
    rows = spark.createDataFrame([(1, 2.0, 0.0), (2, 3.0, 1.0)], "obsid long, mismatch double, sigma double")
    some = inversion.Inversion(control, rows, h)
    assert some.cost(np.zeros(1)) == 4.5 and some.gradient(np.zeros(1)) == pytest.approx([3.0])
    none = inversion.Inversion(control, rows.limit(0), h)
    assert none.cost(np.zeros(1)) == 0 and none.gradient(np.ones(1)) == pytest.approx([1.0])
    kept = some.run(np.zeros(1), "")
    some.run(np.ones(1), "")
    assert not kept.is_cached and some.held.is_cached


def test_sensitivity_is_the_product_of_the_maps(spark):
    obs = spark.createDataFrame([(1, "co2")], "obsid long, tracer string")
    fp = spark.createDataFrame([(1, 0, 0, 0, 2.0), (1, 1, 0, 1, 3.0)], "obsid long, itim int, ilat int, ilon int, sensi double")
    tmap = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25), (1, 1, 0.75)], "itim_opt int, itim_mod int, frac double")
    hmap = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5)], "icell int, ipos int, frac double")
    got = {(r["itime"], r["ipos"]): r["h"] for r in inversion.state_sensitivity(obs, fp, tmap, hmap, 10).collect()}
    assert got == {(0, 0): 2 * 0.5 * 0.5 + 3 * 0.5 * 0.25, (1, 0): 3 * 0.5 * 0.75}


def test_distances_as_arrays_and_rows(spark):
    lat, lon = np.array([40.0, 50.0, 60.0]), np.array([0.0, 10.0, -20.0])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "ipos int, lat double, lon double")
    d = prior.distance_matrix(lat, lon)
    for r in prior.distances(points).collect():
        assert d[r["i"], r["j"]] == pytest.approx(r["distance"], abs=1e-6)


def test_precondition_of_every_category(spark):
    in_time, in_space = roots(Views(spark, DATA))
    states = {}
    for r in coarse_state(Views(spark, DATA)).collect():
        states.setdefault((r["tracer"], r["category"]), np.zeros((len(in_time), len(in_space))))[r["itime"], r["ipos"]] = r["state"]
    for r in QUERIES["precond_apply"](spark, DATA).collect():
        w = states[r["tracer"], r["category"]]
        assert r["x"] == pytest.approx(sum(in_time[r["itime"], t] * in_space[r["ipos"], p] * w[t, p] for t, p in np.ndindex(w.shape)), rel=1e-6, abs=1e-6)


def test_anchor_and_spin(spark):
    days = lambda rows: [r["t0"].day for r in rows.orderBy("t0").collect()]
    assert days(anchored(spark, "2018-01-05", "2018-01-25", step("7D"))) == [8, 15]
    assert days(anchored(spark, "2018-01-05", "2018-01-25", step("7D"), cover=True)) == [1, 8, 15]
    assert days(anchored(spark, "2018-01-01", "2018-01-15", step("7D"))) == [1, 8]
    assert spun("2018-03-31", "2018-12-31", step("MS"), step("2MS")) == ("2018-02-28 00:00:00", "2019-02-28 00:00:00")
    assert later(datetime.datetime(2018, 1, 1), step("12h"), 3) == datetime.datetime(2018, 1, 2, 12)


def test_parts_of_a_combination_are_not_transported(spark):
    v = Views(spark, DATA)
    cube = api.Fluxes(v.flux, v.cell, v.time, (api.Category("fossil", "co2", tagged=True), api.Category("fires", "co2"), api.Category("fires", "ch4")))
    made = cube.add(api.Category("both", "co2", combination="fossil + fires"))
    assert [c.transported for c in made.categories] == [True, False, True, True]


def test_no_footprint_at_all(spark):
    obs = spark.createDataFrame([(1, "a"), (2, "b")], "obsid long, footprint string")
    catalog = spark.createDataFrame([("c",)], "name string")
    with pytest.raises(Exception, match="no footprint file"):
        observations.only_existing(obs, catalog, "footprint", "name", required=True).collect()
    assert observations.only_existing(obs, catalog, "footprint", "name").filter("footprint is not null").isEmpty()


def test_late_rows_of_a_stream_are_modelled(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    fp = spark.createDataFrame([(i, "co2", 0, 0, 0, 1.0) for i in range(3)], "obsid long, tracer string, itim int, ilat int, ilon int, sensi double")
    fluxes = spark.createDataFrame([("co2", "a", 0, 0, 0, 3.0), ("co2", "b", 0, 0, 0, 1.0), ("ch4", "a", 0, 0, 0, 9.0)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    schema = "obsid long, time timestamp, tracer string"
    for k, when in enumerate((day, day + datetime.timedelta(days=9), day - datetime.timedelta(days=9))):
        spark.createDataFrame([(k, when, "co2")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = forward.modelled(stream, fp, fluxes).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["obsid"], r["mix"]) for r in spark.table("late").collect()) == [(i, 4.0) for i in range(3)]

