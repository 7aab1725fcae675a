"""Queries over the domain tables of a folder, one for each operator: name to (function of spark and folder)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions import text, units
from plumeline.functions.expressions import terms_table
from plumeline.functions.timeaxis import anchored, axis, spun, step
from plumeline.operators import background, clusters, flux, footprints, grid, mapping, observations, polygons, prior, solver, transport
from plumeline import api
from plumeline.plans import inversion
from plumeline.sources import archive, tables
from plumeline.sources import footprints as layouts
from plumeline.sources.fixtures import view
from plumeline.sources.shared import kept, new_path, parts_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Grids of the tests: the cells of the fixtures, a coarser and a finer one.
CELLS = grid.Grid.of(lon0=-15, dlon=5, nlon=10, lat0=33, dlat=5, nlat=8)
COARSE = grid.Grid.of(lon0=-15, dlon=12.5, nlon=4, lat0=33, dlat=10, nlat=4)
FINE = grid.Grid.of(lon0=-15, dlon=2.5, nlon=20, lat0=33, dlat=2.5, nlat=16)
CUBE = ["tracer", "category", "itim"]
CATEGORY = ("tracer", "category")


class Views:
    """Domain tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


def r(name: str, digits: int = 6, of: Column | None = None) -> Column:
    return F.round(F.col(name) if of is None else of, digits).alias(name)


def of_many(name: str, digits: int) -> Column:
    """As r(), for rows by the thousand millions: numbers that aren't negative, by arithmetic on doubles as the SQL's round() does it, not by decimal texts."""
    return (F.floor(F.col(name) * 10.0**digits + 0.5) / 10.0**digits).alias(name)


# --- transport ---


@query
def fwd_mix_by_category(v: Views) -> DataFrame:
    return transport.forward(v.obs, v.footprint, v.flux).select("obsid", "category", r("mix", 3))


def modelled(v: Views) -> DataFrame:
    obs = v.obs
    return transport.total(obs, transport.forward(obs, v.footprint, v.flux))


@query
def fwd_mix_total(v: Views) -> DataFrame:
    return modelled(v).select("obsid", r("mix_foreground", 3), r("mix", 3))


@query
def departures(v: Views) -> DataFrame:
    return transport.departures(modelled(v)).select("obsid", r("mix_foreground", 3), r("mismatch", 3), "sigma")


@query
def adjoint_flux(v: Views) -> DataFrame:
    return transport.adjoint(v.obs.select("obsid", "tracer", F.col("obs").alias("dy")), v.footprint).select("tracer", "itim", "ilat", "ilon", r("adj", 3))


@query
def adjoint_by_category(v: Views) -> DataFrame:
    dy = v.obs.select("obsid", "tracer", F.col("obs").alias("dy"))
    return transport.adjoint_by_category(dy, v.footprint, v.flux.select("tracer", "category").distinct()).select("tracer", "category", "itim", "ilat", "ilon", r("adj", 3))


@query
def sensitivity_map(v: Views) -> DataFrame:
    return transport.sensitivity(v.obs, v.footprint).select("tracer", "ilat", "ilon", r("sensi", 6))


@query
def adjoint_test(v: Views) -> DataFrame:
    return transport.adjoint_test(v.obs, v.footprint, v.flux).select(r("hx_y", 1), r("x_hty", 1), r("difference", 8))


# --- observations ---


@query
def obs_flat_join(v: Views) -> DataFrame:
    return observations.flat_table(v.obs, v.sites).select("obsid", "site", "code", "name", "region", "lat", "lon", "alt")


@query
def obs_select_times(v: Views) -> DataFrame:
    return observations.select_times(v.obs, "1995-03-01", "1996-06-30").select("obsid", "site", F.date_format("time", "yyyy-MM-dd").alias("day"))


@query
def obs_time_bounds(v: Views) -> DataFrame:
    return observations.time_bounds(v.obs).select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("tmin", "tmax")])


@query
def obs_select_sites(v: Views) -> DataFrame:
    return observations.select_sites(v.obs, ["s03", "s07", "s11"]).select("obsid", "code", "obs")


@query
def obs_hour_window(v: Views) -> DataFrame:
    rows = v.obs_ts.withColumn("site", F.substring("code", 2, 2).cast("int"))
    return observations.in_hours(rows, v.sites).select("obsid", "site", F.hour("time").cast("int").alias("hour"))


@query
def obs_complete(v: Views) -> DataFrame:
    rows = v.obs.select("obsid", (F.col("mix_background") - F.col("obs")).alias("mismatch"), "err_obs")
    return observations.complete(rows, "mismatch", "err_obs").select("obsid", r("mismatch", 6), "sigma")


@query
def obs_with_driver(v: Views) -> DataFrame:
    return observations.with_driver(v.obs.withColumn("dy", F.col("mix_background") / 4)).select("obsid", "dy")


@query
def obs_err_floor(v: Views) -> DataFrame:
    return observations.floor_errors(v.obs, observations.ErrorSettings(err_min=0.5)).select("obsid", "err_obs")


@query
def obs_rolling_mean(v: Views) -> DataFrame:
    return observations.rolling_means(v.obs_ts).select("obsid", "code", r("obs_rolling"), r("mod_rolling"))


@query
def obs_model_error(v: Views) -> DataFrame:
    return observations.model_errors(v.obs_ts).select("code", r("sigma"))


@query
def obs_inflated_error(v: Views) -> DataFrame:
    settings = observations.ErrorSettings(err_min=0.25, err_fac=1.5)
    return observations.inflated_errors(v.obs_ts, settings).select("obsid", r("obs_detrended"), r("mod_detrended"), r("err"))


@query
def obs_constant_cols(v: Views) -> DataFrame:
    names = observations.constant_columns(v.obs.drop("obsid", "time"))
    return v.spark.createDataFrame([(n,) for n in names], "name string")


@query
def obs_split_table(v: Views) -> DataFrame:
    return observations.split_table(v.obs.select("obsid", "site", "code", "height", "obs"))[1].select("site", "code", "height")


@query
def obs_footprint_names(v: Views) -> DataFrame:
    return observations.footprint_files(v.obs).select("obsid", "footprint")


@query
def obs_ids(v: Views) -> DataFrame:
    rows = observations.footprint_files(v.obs).withColumn("footprint", F.when(F.col("obsid") % 3 != 0, F.col("footprint")))
    return observations.observation_ids(rows).select("obsid", "fp_id")


@query
def obs_missing_footprint(v: Views) -> DataFrame:
    rows = v.obs.select("obsid", F.col("obsid").alias("footprint"))
    return observations.only_existing(rows, v.footprint.filter("itim % 2 = 0"), "footprint", "obsid").select("obsid", "footprint")


@query
def obs_background_merge(v: Views) -> DataFrame:
    found = v.obs.filter("obsid % 4 = 0").select("obsid", (F.col("obs") * 2).alias("mix_background"))
    return observations.merge_background(v.obs, found).select("obsid", "mix_background")


@query
def obs_rename(v: Views) -> DataFrame:
    return observations.renamed(v.obs, {"err_obs": "err", "obs": "value"}).select("obsid", "err_obs", "err", "obs", "value")


@query
def valid_prune_sites(v: Views) -> DataFrame:
    kept = v.obs.filter("err_obs > 0").dropna(subset=["mix_background"])
    return observations.sites_with_observations(v.sites, kept).select("site", "code", "name")


@query
def fp_file_counts(v: Views) -> DataFrame:
    return observations.file_counts(observations.footprint_files(v.obs)).select("footprint", "n")


# --- fluxes ---


def by_year(v: Views) -> DataFrame:
    return v.flux.join(v.time.select("itim", F.year("t0").alias("year")), "itim")


@query
def flux_resample_sum(v: Views) -> DataFrame:
    return flux.resampled(by_year(v), "year").select("tracer", "category", "year", "ilat", "ilon", r("flux", 6))


@query
def flux_resample_mean(v: Views) -> DataFrame:
    return flux.resampled(by_year(v), "year", "avg").select("tracer", "category", "year", "ilat", "ilon", r("flux", 8))


@query
def flux_upsample_ffill(v: Views) -> DataFrame:
    quarterly = flux.resampled(v.flux.withColumn("quarter", (F.floor(F.col("itim") / 3) * 3).cast("int")), "quarter").withColumnRenamed("quarter", "itim")
    return flux.upsampled(quarterly, v.time).select(*flux.KEY, r("flux", 6))


@query
def flux_fill_dense(v: Views) -> DataFrame:
    return flux.dense(v.flux, v.time, v.cell).select(*flux.KEY, r("flux", 6))


@query
def flux_budget_rollup(v: Views) -> DataFrame:
    return flux.budget(v.flux, v.time).select("tracer", "category", "year", "month", r("total", 5))


@query
def flux_metacat(v: Views) -> DataFrame:
    return flux.metacategories(v.flux, v.metacat_terms).select(*flux.KEY, r("flux", 6))


@query
def flux_resolve_metacats(v: Views) -> DataFrame:
    terms = terms_table(v.spark, {"all": "fossil + fires + biosphere", "less": "fossil - 0.5*biosphere"})
    return flux.resolved(v.flux, terms).groupBy("category").agg(F.count("*").alias("n"), r("total", 2, F.sum("flux")))


@query
def flux_to_extensive(v: Views) -> DataFrame:
    return flux.to_extensive(v.flux, v.cell, v.time).select(*flux.KEY, r("flux", 3, F.col("flux") / 1e15))


@query
def flux_to_intensive(v: Views) -> DataFrame:
    return flux.to_intensive(v.flux, v.cell, v.time).select(*flux.KEY, r("flux", 4, F.col("flux") * 1e18))


@query
def flux_in_unit(v: Views) -> DataFrame:
    each = [flux.in_unit(v.flux.filter(F.col("tracer") == name), v.cell, v.time, units.species(name)["emission"], units.species(name)["budget"]) for name in ("co2", "ch4")]
    return each[0].unionByName(each[1]).select(*flux.KEY, r("flux", 7))


@query
def flux_half_open(v: Views) -> DataFrame:
    return flux.half_open(v.flux, 12, 24).select(*flux.KEY, r("flux", 6))


@query
def flux_add_category(v: Views) -> DataFrame:
    return flux.with_category(v.flux, "ocean", 1.5).groupBy("tracer", "category").agg(F.count("*").alias("n"), r("total", 3, F.sum("flux")))


@query
def flux_transported(v: Views) -> DataFrame:
    meta = v.flux.select("tracer", "category").distinct().withColumn("transported", F.col("category") != "fires")
    return flux.chosen(v.flux, meta, "transported").select(*flux.KEY, r("flux", 6))


@query
def flux_bounds(v: Views) -> DataFrame:
    return flux.bounds(v.flux, v.cell)


@query
def flux_nonzero(v: Views) -> DataFrame:
    return flux.nonzero(flux.dense(v.flux, v.time, v.cell)).groupBy("tracer").agg(F.count("*").alias("n"))


# --- grids ---


@query
def grid_cell_area(v: Views) -> DataFrame:
    """Areas of the cells that have fluxes, and the fluxes' sums by area."""
    sums = v.flux.groupBy("ilat", "ilon").agg(F.sum("flux").alias("flux"))
    return CELLS.cells(v.spark).join(sums, ["ilat", "ilon"]).select("ilat", "ilon", "icell", "lat_s", "lon_w", r("area", 0), r("density", 6, F.col("flux") / F.col("area") * 1e6))


@query
def grid_overlap_lat(v: Views) -> DataFrame:
    """Overlaps of latitudes, and what of each row's fluxes lies in them."""
    rows = v.flux.groupBy(F.col("ilat").alias("i")).agg(F.sum("flux").alias("flux"))
    return grid.overlaps(CELLS.axis(v.spark, "lat"), COARSE.axis(v.spark, "lat"), "sine").join(rows, "i").select("i", "j", r("frac", 9), r("part", 3, F.col("flux") * F.col("frac")))


@query
def grid_overlap_lon(v: Views) -> DataFrame:
    """Overlaps of longitudes, and what of each column's fluxes lies in them."""
    rows = v.flux.groupBy(F.col("ilon").alias("i")).agg(F.sum("flux").alias("flux"))
    return grid.overlaps(CELLS.axis(v.spark, "lon"), COARSE.axis(v.spark, "lon")).join(rows, "i").select("i", "j", r("frac", 9), r("part", 3, F.col("flux") * F.col("frac")))


@query
def grid_coarsen(v: Views) -> DataFrame:
    return grid.regrid(v.flux, CELLS, COARSE, CUBE).select(*CUBE, "ilat", "ilon", r("flux", 6))


@query
def grid_refine(v: Views) -> DataFrame:
    return grid.regrid(v.flux, CELLS, FINE, CUBE).select(*CUBE, "ilat", "ilon", r("flux", 7))


@query
def grid_to_quantity(v: Views) -> DataFrame:
    return grid.to_quantity(v.flux, v.cell).select(*CUBE, "ilat", "ilon", r("flux", 3, F.col("flux") / 1e9))


@query
def grid_crop(v: Views) -> DataFrame:
    return grid.cropped(v.flux, v.cell, 38, 63, -5, 25).select(*CUBE, "ilat", "ilon", r("flux", 6))


@query
def grid_pad(v: Views) -> DataFrame:
    return grid.padded(v.flux, 1, 2, 0, 3, 8, 10, CUBE, padding=-1.0).select(*CUBE, "ilat", "ilon", r("flux", 6))


@query
def grid_land_mask(v: Views) -> DataFrame:
    fine = v.cell.select("ilat", "ilon", "area", F.col("land_fraction").alias("mask"))
    by_lat = grid.overlaps(CELLS.axis(v.spark, "lat"), COARSE.axis(v.spark, "lat"), "sine")
    by_lon = grid.overlaps(CELLS.axis(v.spark, "lon"), COARSE.axis(v.spark, "lon"))
    return grid.land_share(fine, by_lat, by_lon).select("ilat", "ilon", r("land_fraction", 9))


@query
def grid_land_polygons(v: Views) -> DataFrame:
    """The share of land of all cells, whose land are polygons around the sites."""
    return polygons.land_fractions(v.cell, v.polygons, 4).select("icell", r("land_fraction", 9))


# --- mapping ---


def model_axis(v: Views) -> DataFrame:
    days = F.date_diff("t0", F.lit("1995-01-01").cast("date")).cast("double")
    return v.time.select(F.col("itim").alias("i"), days.alias("t0"), (days + F.col("dt") / 86400).alias("t1"))


def opt_axis(v: Views) -> DataFrame:
    """Steps of three months that begin ten days late."""
    return model_axis(v).groupBy(F.floor(F.col("i") / 3).cast("int").alias("i")).agg((F.min("t0") + 10).alias("t0"), (F.max("t1") + 10).alias("t1"))


def tmap(v: Views) -> DataFrame:
    return mapping.temporal(model_axis(v), opt_axis(v))


def members(v: Views) -> DataFrame:
    """Cells in clusters of two by two."""
    return v.cell.select("icell", (F.floor(F.col("ilat") / 2) * 5 + F.floor(F.col("ilon") / 2)).cast("int").alias("ipos"))


def cell_flux(v: Views) -> DataFrame:
    return v.flux.withColumn("icell", F.col("ilat") * 10 + F.col("ilon"))


def coarse_state(v: Views) -> DataFrame:
    return mapping.coarsened(cell_flux(v), tmap(v), mapping.clusters_of(members(v)))


@query
def map_temporal_overlap(v: Views) -> DataFrame:
    return tmap(v).select("itim_opt", "itim_mod", r("frac", 9))


@query
def map_clusters(v: Views) -> DataFrame:
    return mapping.clusters_of(members(v))


@query
def map_native_cells(v: Views) -> DataFrame:
    return mapping.native_cells(v.cell).select("icell", F.col("ipos").cast("long").alias("ipos"), "frac")


@query
def map_coarsen(v: Views) -> DataFrame:
    return coarse_state(v).select("tracer", "category", "itime", "ipos", r("state", 5))


@query
def map_distribute_time(v: Views) -> DataFrame:
    return mapping.over_time(coarse_state(v), tmap(v), ["tracer", "category", "ipos"]).select("tracer", "category", "ipos", "itim_mod", r("value", 9))


@query
def map_distribute_time_adj(v: Views) -> DataFrame:
    rows = cell_flux(v).select("tracer", "category", "icell", F.col("itim").alias("itim_mod"), F.col("flux").alias("value"))
    return mapping.over_time_adjoint(rows, tmap(v), ["tracer", "category", "icell"]).select("tracer", "category", "icell", "itime", r("state", 9))


@query
def map_distribute_space(v: Views) -> DataFrame:
    return mapping.over_space(coarse_state(v), mapping.clusters_of(members(v)), ["tracer", "category", "itime"]).select("tracer", "category", "itime", "icell", r("value", 7))


@query
def map_distribute_space_adj(v: Views) -> DataFrame:
    rows = cell_flux(v).select("tracer", "category", "itim", "icell", F.col("flux").alias("value"))
    return mapping.over_space_adjoint(rows, mapping.clusters_of(members(v)), ["tracer", "category", "itim"]).select("tracer", "category", "itim", "ipos", r("state", 7))


@query
def map_state_to_flux(v: Views) -> DataFrame:
    found = mapping.state_to_flux(cell_flux(v), coarse_state(v), tmap(v), mapping.clusters_of(members(v)))
    return found.groupBy("tracer", "category", "itim").agg(F.count("*").alias("n"), r("total", 2, F.sum("flux")))


@query
def map_cluster_attrs(v: Views) -> DataFrame:
    return mapping.cluster_attributes(v.cell, mapping.clusters_of(members(v))).select("ipos", r("lat"), r("lon"), r("land_fraction"), r("area", 0))


@query
def map_control_axes(v: Views) -> DataFrame:
    positions = members(v).select("ipos").distinct()
    return mapping.control_axes(positions, opt_axis(v).select(F.col("i").alias("itime"), (F.col("t1") - F.col("t0")).alias("dt")))


@query
def map_clusterize(v: Views) -> DataFrame:
    totals = v.cell.join(v.flux.groupBy("ilat", "ilon").agg(F.sum("flux").alias("flux")), ["ilat", "ilon"], "left").withColumns({"flux": F.coalesce("flux", F.lit(0.0)), "land": F.col("land_fraction") > 0})
    return clusters.cluster_rows(totals, 20, "flux", "land")


# --- prior ---


def positions(v: Views) -> DataFrame:
    return mapping.cluster_attributes(v.cell, mapping.clusters_of(members(v)))


def sigma_rows(v: Views) -> DataFrame:
    """Errors of all categories at all steps and positions."""
    return coarse_state(v).select(*CATEGORY, "itime", "ipos", (F.abs("state") / 1000).alias("sigma"))


def steps(v: Views) -> DataFrame:
    return opt_axis(v).select(F.col("i").alias("itime"))


@query
def prior_distance(v: Views) -> DataFrame:
    points = v.cell.select(F.col("icell").alias("ipos"), (F.col("lat_s") + 2.5).alias("lat"), (F.col("lon_w") + 2.5).alias("lon"))
    return prior.distances(points).select("i", "j", r("distance", 4))


def corr_query(kind: str) -> None:
    def corr(v: Views) -> DataFrame:
        return prior.mirrored(prior.spatial_correlations(prior.distances(positions(v)), kind, 500.0), "corr").select("i", "j", r("corr", 9))

    corr.__name__ = f"prior_corr_{kind}"
    query(corr)


for _kind in prior.KERNELS:
    corr_query(_kind)


@query
def prior_neighbours(v: Views) -> DataFrame:
    return prior.neighbours(v.positions, 500.0).select("i", "j", of_many("distance", 4))


@query
def prior_corr_near(v: Views) -> DataFrame:
    return prior.near_correlations(v.positions, "e", 60.0).select("i", "j", of_many("corr", 9))


@query
def prior_temporal_corr(v: Views) -> DataFrame:
    return prior.temporal_correlations(steps(v), 91.0, 60.0).select("i", "j", r("corr", 9))


@query
def prior_errors(v: Views) -> DataFrame:
    return prior.prior_errors(v.flux).select(*flux.KEY, r("sigma", 6))


def total_sigma(v: Views) -> DataFrame:
    spatial = prior.mirrored(prior.spatial_correlations(prior.distances(positions(v)), "e", 500.0), "corr")
    return prior.total_uncertainty(sigma_rows(v), prior.temporal_correlations(steps(v), 91.0, 60.0), spatial, CATEGORY)


@query
def prior_total_uncertainty(v: Views) -> DataFrame:
    return total_sigma(v).select(*CATEGORY, r("total", 5))


@query
def prior_scale(v: Views) -> DataFrame:
    times = opt_axis(v).select(F.col("i").alias("itime"), ((F.col("t1") - F.col("t0")) * 86400).alias("dt"))
    rows = prior.scaled_errors(sigma_rows(v), total_sigma(v), 5.0, times, CATEGORY)
    return rows.select(*CATEGORY, "itime", "ipos", r("sigma", 8))


def roots(v: Views) -> tuple[np.ndarray, np.ndarray]:
    """Covariance roots in time and space."""
    n_time, n_space = steps(v).count(), members(v).select("ipos").distinct().count()
    out = []
    for n, rows in ((n_time, prior.temporal_correlations(steps(v), 91.0, 60.0)), (n_space, prior.mirrored(prior.spatial_correlations(prior.distances(positions(v)), "e", 500.0), "corr"))):
        corr = np.zeros((n, n))
        for x in rows.collect():
            corr[x["i"], x["j"]] = x["corr"]
        out.append(corr)
    return prior.temporal_root(out[0]), prior.spatial_root(out[1])


@query
def precond_apply(v: Views) -> DataFrame:
    """Of the state of every category."""
    in_time, in_space = roots(v)
    states: dict[tuple, np.ndarray] = {}
    for x in coarse_state(v).collect():
        states.setdefault((x["tracer"], x["category"]), np.zeros((len(in_time), len(in_space))))[x["itime"], x["ipos"]] = x["state"]
    made = {k: prior.precondition(w, np.ones(w.shape), in_time, in_space) for k, w in states.items()}
    return v.spark.createDataFrame([(*k, int(t), int(p), float(x)) for k, state in made.items() for (t, p), x in np.ndenumerate(state)], "tracer string, category string, itime int, ipos int, x double")


# --- costs and minimisers ---


def scaled_departures(v: Views) -> DataFrame:
    return observations.floor_errors(v.obs, observations.ErrorSettings(err_min=2.0)).select("obsid", (F.col("mix_background") - F.col("obs")).alias("mismatch"), F.col("err_obs").alias("sigma")).dropna()


@query
def cost_function(v: Views) -> DataFrame:
    return solver.observation_cost(scaled_departures(v)).select(r("j_obs", 1), "n_obs")


@query
def state_cost(v: Views) -> DataFrame:
    return solver.state_cost(sigma_rows(v).withColumnRenamed("sigma", "state")).select(r("j_bg", 4))


@query
def gradient_norm(v: Views) -> DataFrame:
    return solver.norm(transport.adjoint(v.obs.select("obsid", "tracer", F.col("obs").alias("dy")), v.footprint), "adj").select(r("norm", 3))


@query
def chi2(v: Views) -> DataFrame:
    return solver.reduced_chi2(solver.observation_cost(scaled_departures(v)), 10).select(r("chi2", 4), "n_obs")


@query
def lanczos_posterior(v: Views) -> DataFrame:
    """Posterior errors of a state of quarters and clusters, seen by the footprints of all observations."""
    obs = v.obs.filter("mix_background is not null")
    in_time, in_space = roots(v)
    footprint = v.footprint
    sensitivity = inversion.state_sensitivity(obs, footprint, tmap(v), mapping.clusters_of(members(v)), 10).persist()
    rows = observations.floor_errors(obs, observations.ErrorSettings(err_min=2.0)).select("obsid", (F.col("mix_background") - F.col("obs")).alias("mismatch"), F.col("err_obs").alias("sigma"))
    rows = rows.repartition(parts_of(footprint), "obsid").persist()  # as the footprints are dealt: no iteration shuffles either
    problem = inversion.Inversion(inversion.Control(np.full((len(in_time), len(in_space)), 50.0), in_time, in_space), rows, sensitivity)
    found = problem.solve(iterations=6)
    state, sigma = problem.control.to_state(found.x), problem.posterior(found)
    for table in (sensitivity, rows, problem.held):
        table.unpersist()
    return v.spark.createDataFrame([(int(t), int(p), float(state[t, p]), float(s)) for (t, p), s in np.ndenumerate(sigma)], "itime int, ipos int, state double, sigma double")


# --- footprints ---


@query
def fp_unique(v: Views) -> DataFrame:
    return transport.unique_footprints(v.footprint.withColumn("itim", (F.floor(F.col("itim") / 6) * 6).cast("int"))).select("obsid", "itim", "ilat", "ilon", r("sensi", 5))


@query
def fp_trim(v: Views) -> DataFrame:
    return footprints.trimmed(v.footprint, 1, -3).select("obsid", "itim", "ilat", "ilon", r("sensi", 5))


@query
def fp_release_fold(v: Views) -> DataFrame:
    return footprints.release_folded(v.footprint.withColumn("at_release_end", F.col("obsid") % 2 == 0)).select("obsid", "itim", "ilat", "ilon", r("sensi", 5))


@query
def fp_unit_fix(v: Views) -> DataFrame:
    rows = v.footprint.withColumn("units", F.when(F.col("obsid") % 3 == 0, "s m3 kg-1").otherwise("mol"))
    return footprints.unit_fixed(rows).select("obsid", "itim", "ilat", "ilon", r("sensi", 9))


@query
def src_footprint_reader(v: Views) -> DataFrame:
    """Footprints as a file has them (units, ends of releases), read onto a model's axis that begins two steps earlier, of two steps at most before the last."""
    day = timedelta(days=1)
    origin = datetime(1995, 1, 1)
    last = F.timestamp_micros(F.unix_micros(F.lit(str(origin)).cast("timestamp")) + F.max("itim").cast("long") * 86_400_000_000)
    ends = v.footprint.groupBy("obsid").agg(last.alias("last"))
    kept = v.footprint.join(ends, "obsid").select("obsid", "itim", "ilat", "ilon", "sensi", F.when(F.col("obsid") % 3 == 0, "s m3 kg-1").otherwise("mol").alias("units"), F.when(F.col("obsid") % 2 == 0, F.col("last")).alias("release_end"))
    path = new_path(v.spark, "footprints")
    kept.write.parquet(path)
    read = replace(layouts.reader("parquet")(v.spark, path, CELLS, 86400, origin), longest=2)
    return read.align(CELLS, 86400, origin - 2 * day).rows().select("obsid", "itim", "ilat", "ilon", r("sensi", 9))


@query
def flux_as_vector(v: Views) -> DataFrame:
    return api.Fluxes(v.flux, v.cell, v.time, ()).as_vector("fires").select("tracer", "k", r("flux", 5))


@query
def src_cube_of_a_tracer(v: Views) -> DataFrame:
    """What is read of one tracer of a cube that was written."""
    path = new_path(v.spark, "cube")
    known = tuple(api.Category(c, t) for t in ("co2", "ch4") for c in ("fossil", "fires", "biosphere"))
    api.Fluxes(v.flux, v.cell, v.time, known).write(path)
    return api.Fluxes.read(v.spark, path, ["co2"]).flux.select(*flux.KEY, r("flux", 5))


@query
def fp_dense_to_coo(v: Views) -> DataFrame:
    columns = [F.sum(F.when(F.col("ilon") == k, F.col("sensi")).otherwise(0.0)) for k in range(10)]
    dense = v.footprint.groupBy("obsid", "ilat").agg(F.array(*columns).alias("values"))
    return footprints.dense_to_rows(dense).select("obsid", "ilat", F.col("ilon").cast("int").alias("ilon"), r("sensi", 5))


@query
def fp_compressed_to_coo(v: Views) -> DataFrame:
    """Footprints written as arrays of steps and read back."""
    rows = v.footprint.groupBy("obsid").agg(F.array_sort(F.collect_list(F.struct("itim", "ilat", "ilon", "sensi"))).alias("a"))
    first = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda k: (k == 0) | (F.element_at("a", k + 1)["itim"] != F.element_at("a", F.greatest(k, F.lit(1)))["itim"]))
    field = lambda c: F.transform("a", lambda x: x[c].cast("double"))
    packed = rows.select("obsid", F.concat(first, F.array(F.size("a"))).alias("indptr"), field("ilon").alias("lon"), field("ilat").alias("lat"), field("sensi").alias("val"))
    return footprints.compressed_to_rows(packed).select("obsid", "itim", "lon", "lat", r("sensi", 5))


@query
def fp_clip(v: Views) -> DataFrame:
    rows = v.footprint.withColumns({"lat": 35.5 + 5.0 * F.col("ilat"), "lon": -12.5 + 5.0 * F.col("ilon")})
    moved = footprints.clipped(rows, 40.0, 60.0, 0.0, 30.0)
    return moved.select("obsid", "itim", footprints.index_of(F.col("lat"), 40.0, 2.5).alias("jlat"), footprints.index_of(F.col("lon"), 0.0, 2.5).alias("jlon"))


@query
def fp_misaligned(v: Views) -> DataFrame:
    return footprints.misaligned(v.footprint, 60, 8, 9)


@query
def fp_catalog(v: Views) -> DataFrame:
    parts = [v.footprint.filter(f"itim % 2 = {k}").select("obsid", F.concat(F.lit(f"file{k}-"), F.col("itim")).alias("footprint")) for k in (0, 1)]
    return footprints.catalog(parts)


# --- background ---


@query
def bg_interp_height(v: Views) -> DataFrame:
    return background.at_endpoints(v.endpoints, v.conc).select("particle", r("background", 6))


@query
def bg_mean(v: Views) -> DataFrame:
    return background.mean_background(background.at_endpoints(v.endpoints, v.conc)).select("obsid", r("mix_background", 6))


@query
def bg_mid_height(v: Views) -> DataFrame:
    rows = v.conc.withColumn("column", F.lit(1))
    return background.height_above_ground(background.mid_heights(rows, ["column"]), ["column"]).select("ilev", "mid", "height_above_ground")


@query
def bg_multilinear(v: Views) -> DataFrame:
    """The land fraction of cell centres between them, at all end points."""
    cells = v.cell
    points = v.endpoints.select(F.col("particle").alias("point"), "lat", "lon")
    axes = {"ilat": ("lat", cells.select(F.col("ilat").alias("index"), (F.col("lat_s") + 2.5).alias("position")).distinct()), "ilon": ("lon", cells.select(F.col("ilon").alias("index"), (F.col("lon_w") + 2.5).alias("position")).distinct())}
    return background.multilinear(points, cells.select("ilat", "ilon", F.col("land_fraction").alias("value")), axes).select("point", r("value", 6))


@query
def bg_four_axes(v: Views) -> DataFrame:
    """The background at all end points, from columns of air whose heights differ by place and time."""
    points = v.endpoints.withColumnRenamed("particle", "point")
    return background.at_trajectory_ends(points, v.conc4).select(F.col("point").alias("particle"), r("background", 6))


@query
def bg_four_axes_mean(v: Views) -> DataFrame:
    points = v.endpoints.withColumnRenamed("particle", "point")
    return background.mean_background(background.at_trajectory_ends(points, v.conc4)).select("obsid", r("mix_background", 6))


def with_tracer(v: Views) -> tuple[DataFrame, DataFrame]:
    """Departures and H by observation, as an inversion keeps them."""
    seen = v.footprint.join(v.obs.select("obsid", "tracer"), "obsid")
    return v.obs.select("obsid", F.col("obs").alias("dy")), seen


@query
def h_bucketed_forward(v: Views) -> DataFrame:
    """Hx of all fluxes, from H written by buckets of observations."""
    with tables.Bucketed(v.spark, new_path(v.spark, "sensitivity"), "obsid", 8) as keep:
        h = keep(with_tracer(v)[1])
        x = v.flux.groupBy("tracer", *transport.CELL).agg(F.sum("flux").alias("x"))
        hx = h.join(F.broadcast(x), ["tracer", *transport.CELL]).groupBy("obsid").agg(F.sum(F.col("sensi") * F.col("x")).alias("hx"))
        return kept(v.spark, hx.select("obsid", r("hx", 3)))


@query
def h_bucketed_adjoint(v: Views) -> DataFrame:
    """H'y of all observations, both written by the same buckets."""
    with tables.Bucketed(v.spark, new_path(v.spark, "sensitivity"), "obsid", 8) as keep:
        y, h = map(keep, with_tracer(v))
        return kept(v.spark, transport.adjoint_of(y, h).select("tracer", *transport.CELL, r("adj", 3)))


@query
def archive_fallback(v: Views) -> DataFrame:
    """Fluxes of all steps from an archive in which one category has every other month and a static field, one has years, and one is static."""
    path, cube, times = new_path(v.spark, "archive"), v.flux, v.time
    archive.write(cube.filter("category = 'fossil' and itim % 2 = 0"), times, path)
    archive.write(cube.filter("category = 'fires'"), times, path, "year")
    field = cube.filter("category <> 'fires'").groupBy("tracer", "category", "ilat", "ilon").agg(F.sum("flux").alias("flux"))
    archive.write(field.crossJoin(F.broadcast(times.agg(F.min("itim").alias("itim")))), times, path, "static")
    return archive.read(v.spark, path, times).select(*flux.KEY, r("flux", 5))


# --- the rest ---


@query
def union_vectors(v: Views) -> DataFrame:
    rows = [coarse_state(v).filter(F.col("tracer") == t) for t in ("co2", "ch4")]
    return rows[0].unionByName(rows[1]).groupBy("tracer", "category").agg(F.count("*").alias("n"))


def period(v: Views) -> tuple[str, str]:
    """The days of the first and the last observation."""
    return tuple(observations.time_bounds(v.obs).select(*[F.date_format(c, "yyyy-MM-dd") for c in ("tmin", "tmax")]).first())


@query
def opt_anchor(v: Views) -> DataFrame:
    """Weeks of optimisation that don't depend on when the observations begin."""
    return anchored(v.spark, *period(v), step("7D")).select(F.col("itim").cast("long").alias("itime"), *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("t0", "t1")])


@query
def spin_axis(v: Views) -> DataFrame:
    """Days of the model with a month before and after the observations."""
    return axis(v.spark, *spun(*period(v), step("MS"), step("MS")), step("D")).select(F.col("itim").cast("long").alias("itim"), F.date_format("t0", "yyyy-MM-dd").alias("day"))


@query
def endpoints_time(v: Views) -> DataFrame:
    rows = v.endpoints.select("particle", "obsid", (F.col("particle") * 60).alias("seconds"))
    return background.endpoint_times(rows, "1995-01-01 06:00:00").select("particle", "obsid", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"))


@query
def time_axis(v: Views) -> DataFrame:
    """Months of a period that ends within one, and the observations in each."""
    steps = axis(v.spark, "1995-01-01", "1996-01-20", step("MS"))
    seen = v.obs.select(F.date_trunc("month", "time").alias("t0"), F.col("time").cast("timestamp").alias("time")).join(steps, "t0").filter("time < t1").groupBy("itim").agg(F.count(F.lit(1)).alias("n_obs"))
    return steps.join(seen, "itim", "left").select(F.col("itim").cast("long").alias("itim"), F.date_format("t0", "yyyy-MM-dd").alias("day"), "dt", F.coalesce("n_obs", F.lit(0).cast("long")).alias("n_obs"))


@query
def portal_sanitize(v: Views) -> DataFrame:
    rows = v.sites.select("site", F.concat(F.col("name"), F.lit(" [x]'\"{é} 1.5"), F.col("region")).alias("text"))
    return rows.select("site", text.plain(F.col("text")).alias("text"))
