"""An inversion from settings: period, fluxes, mapping and prior of every optimised category, steps kept, restart.

The settings are those of sources.config, with the sections run, observations, emissions,
optimize and model; tables are Parquet. Observations have obsid, time, tracer, obs,
err_obs and mix_background.
"""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import asdict, dataclass
from datetime import datetime

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline import api
from plumeline.functions import units
from plumeline.functions.checks import checked
from plumeline.functions.timeaxis import Step, anchored, axis, later, spun, step
from plumeline.functions.timing import timed
from plumeline.operators import flux, mapping, observations, transport
from plumeline.operators.grid import Grid
from plumeline.plans import inversion
from plumeline.sources import footprints, tables


@dataclass
class Controls:
    """Control vectors of several categories as one: blocks one after the other in time; elements beyond a block's positions have no error."""

    blocks: list[inversion.Control]

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum([b.shape[0] for b in self.blocks])]).astype(int)
        self.shape = int(self.first[-1]), max(b.shape[1] for b in self.blocks)
        self.sigma = self.spread([b.sigma for b in self.blocks])

    def spread(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(self.shape)
        for k, part in enumerate(parts):
            out[self.first[k] : self.first[k + 1], : part.shape[1]] = part
        return out

    def parts(self, whole: np.ndarray) -> list[np.ndarray]:
        return [whole.reshape(self.shape)[self.first[k] : self.first[k + 1], : b.shape[1]] for k, b in enumerate(self.blocks)]

    def to_state(self, w: np.ndarray) -> np.ndarray:
        return self.spread([b.to_state(p) for b, p in zip(self.blocks, self.parts(w), strict=True)])

    def to_control(self, gradient: np.ndarray) -> np.ndarray:
        return self.spread([b.to_control(p).reshape(b.shape) for b, p in zip(self.blocks, self.parts(gradient), strict=True)]).ravel()


def files_in(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def preprocessed(spark: SparkSession, folder: str, prefix: str, times: DataFrame, by: Step, field: str = "flux", source: Step | None = None, months: list[str] | None = None) -> DataFrame:
    """Fluxes (time, ilat, ilon, a field) of the monthly, yearly or static files of a prefix, on the model's axis (itim, t0, t1).

    Files have steps of `source`, the model's own by default; longer ones count for all steps that begin in them. Times that are
    no step's are an error when the rows are computed: the files have another frequency. `months` are those of the axis, if they are known.
    """
    if source is not None and bool(source.months) == bool(by.months):
        flux.steps_within(source, by)  # raises where steps of files aren't whole ones of the model
    if months is None:
        months = [r[0] for r in times.select(F.date_format("t0", "yyyy-MM").alias("m")).distinct().orderBy("m").collect()]
    rows = spark.read.parquet(*[f"{folder}/{name}" for name in tables.files_for_months(files_in(spark, folder), prefix, months)])
    rows = rows.select(F.col("time").cast("timestamp").alias("time"), "ilat", "ilon", F.col(field).alias("flux"))
    period = F.broadcast(times.agg(F.min("t0").alias("start"), F.max("t1").alias("end")))
    begins = times.select("itim", F.col("t0").alias("time")) if source in (None, by) else times.select("itim", stepped(source).alias("time"))
    met = rows.crossJoin(period).filter(F.col("time") < F.col("end")).join(begins, "time", "left")
    there = F.col("itim").isNotNull()
    right = checked(met, there | (F.col("time") < F.col("start")), f"{folder}/{prefix} has another frequency", there)
    return right.select("itim", "ilat", "ilon", "flux")


def months_of(start: str, end: str) -> list[str]:
    """The months (2018-01) that a half-open period has a part of."""
    at, last = datetime.fromisoformat(start), datetime.fromisoformat(end)
    out, month = [], datetime(at.year, at.month, 1)
    while month < last:
        out.append(f"{month:%Y-%m}")
        month = later(month, Step(months=1))
    return out


def stepped(by: Step) -> Column:
    """The begin of the step that t0 is in."""
    if by.months:
        return F.date_trunc({1: "month", 3: "quarter", 12: "year"}[by.months], "t0")
    return F.timestamp_micros((F.floor(F.unix_micros("t0") / (by.seconds * 1_000_000)) * (by.seconds * 1_000_000)).cast("long"))


def grid_of(settings: dict) -> Grid:
    return Grid.of(**settings)


def fluxes(spark: SparkSession, settings: dict, start: str, end: str, land: DataFrame | None = None) -> dict[str, api.Fluxes]:
    """The flux cube of every tracer, with its categories, combinations and what is optimised."""
    out = {}
    for tracer in settings["emissions"]["tracers"]:
        own = settings["emissions"][tracer]
        by = step(own["interval"])
        times = axis(spark, start, end, by).persist()
        made, categories = None, []
        for name, how in own["categories"].items():
            how = {"origin": how} if isinstance(how, str) else how
            source = how.get("resample_from", own["interval"])
            rows = preprocessed(spark, f"{own['path']}/{source}", f"{own.get('prefix', '')}{how['origin']}.", times, by, how.get("field", "flux"), step(source), months_of(start, end))
            rows = rows.select(F.lit(tracer).alias("tracer"), F.lit(name).alias("category"), "itim", "ilat", "ilon", "flux")
            made = rows if made is None else made.unionByName(rows)
            categories.append(category(settings, tracer, name, tagged=bool(how.get("transported"))))
        cube = api.Fluxes(made, api.cells_of(spark, grid_of(own["region"]), land), times, tuple(categories))
        for name, text in own.get("metacategories", {}).items():
            cube = cube.add(category(settings, tracer, name, combination=text))
        out[tracer] = cube.resolve() if own.get("metacategories") else cube
    return out


def category(settings: dict, tracer: str, name: str, **more) -> api.Category:
    how = settings["optimize"]["emissions"].get(tracer, {}).get(name)
    if how is None:
        return api.Category(name, tracer, **more)
    amount, unit = how["annual_uncertainty"].split()
    target = float(amount) * units.conversion(unit, units.species(tracer)["optimisation"]).factor
    days = step(how["temporal_correlation"])
    return api.Category(name, tracer, optimised=True, horizontal=how["spatial_correlation"], temporal=days.seconds / 86400 or days.months * 30.4375, target=target, **more)


@dataclass
class Block:
    """One optimised category: its maps, its axis, and what its state stands for."""

    category: api.Category
    maps: api.Mapping
    control: inversion.Control
    amounts: DataFrame
    times: DataFrame


def block(settings: dict, cube: api.Fluxes, own: api.Category, start: str, end: str, cache: str | None = None) -> Block:
    """Mapping, errors (the absolute fluxes, aggregated like these) and correlations of a category."""
    spark, how = cube.spark, settings["optimize"]["emissions"][own.tracer][own.name]
    by, region = step(how["optimization_interval"]), grid_of(settings["emissions"][own.tracer]["region"])
    days = lambda t: F.unix_micros(F.col(t).cast("timestamp")) / 86400e6
    steps = anchored(spark, start, end, by, bool(how.get("cover"))).select(F.col("itim").alias("i"), days("t0").alias("t0"), days("t1").alias("t1")).persist()
    model = cube.times.select(F.col("itim").alias("i"), days("t0").alias("t0"), days("t1").alias("t1"))
    extensive = flux.in_unit(cube.flux.filter(F.col("category") == own.name), cube.cells, cube.times, units.species(own.tracer)["emission"], units.species(own.tracer)["optimisation"])
    errors = extensive.withColumns({"flux": F.abs("flux"), "icell": F.col("ilat") * region.nlon + F.col("ilon")}).persist()
    weights = errors.groupBy("icell").agg(F.sum("flux").alias("weight"))
    maps = api.Mapping(cube.cells.join(weights, "icell", "left").fillna(0.0, ["weight"]).withColumn("on_land", F.col("land_fraction") > 0), model, steps)
    land = how.get("apply_lsm", True)
    if how.get("npoints"):
        maps.by_clusters(how["npoints"], "weight", "on_land" if land else None)
    elif land:
        maps.on_land()
    maps.hmap = maps.hmap.persist()
    n_time, n_space = steps.count(), maps.hmap.select("ipos").distinct().count()
    sigma = np.zeros((n_time, n_space))
    for r in maps.control(errors).collect():
        sigma[r["itime"], r["ipos"]] = r["state"]
    length = steps.agg(F.avg(F.col("t1") - F.col("t0"))).first()[0]
    amounts = extensive.select("tracer", "category", "itim", (F.col("ilat") * region.nlon + F.col("ilon")).alias("icell"), "flux")
    return Block(own, maps, api.Prior(own, maps.positions(), n_time, length).control(sigma, cache), amounts, cube.times)


@timed
def setup(spark: SparkSession, settings: dict, land: DataFrame | None = None) -> tuple[inversion.Inversion, list[Block], DataFrame]:
    """The problem, its blocks, and the modelled prior (observations with mix)."""
    run = settings["run"]
    start, end = spun(run["start"], run["end"], step(run.get("spinup", "0s")), step(run.get("spindown", "0s")))
    cubes = fluxes(spark, settings, start, end, land)
    obs = observations.select_times(spark.read.parquet(settings["observations"]["file"]), run["start"], run["end"])
    errors = observations.ErrorSettings().update(**settings["observations"].get("uncertainties", {}))
    obs = observations.floor_errors(obs, errors)
    seen, apri = [], None
    blocks: list[Block] = []
    for tracer, cube in cubes.items():
        own, how = settings["emissions"][tracer], settings["model"]
        grid, by = grid_of(own["region"]), step(own["interval"])
        read = footprints.reader(how.get("reader", "parquet"))(spark, how["footprints"], grid, by.seconds, datetime.fromisoformat(how.get("origin", start)))
        rows = read.align(grid, by.seconds, datetime.fromisoformat(start)).rows()
        mine = obs.filter(F.col("tracer") == tracer)
        mixes = transport.total(mine, transport.forward(mine, rows, cube.transported().flux))
        apri = mixes if apri is None else apri.unionByName(mixes)
        for c in (c for c in cube.categories if c.optimised):
            b = block(settings, cube, c, start, end, run.get("cache"))
            # the state is an amount of each step and position; a cell's share of it is a flux
            h = inversion.state_sensitivity(mine, per_amount(rows, cube, units.species(tracer)), b.maps.tmap, b.maps.hmap, grid.nlon)
            seen.append(h.withColumn("itime", F.col("itime") + sum(x.control.shape[0] for x in blocks)))
            blocks.append(b)
    if not blocks:
        raise ValueError("nothing is optimised")
    sensitivity = seen[0]
    for h in seen[1:]:
        sensitivity = sensitivity.unionByName(h)
    departures = transport.departures(apri, errors.field_err_obs).select("obsid", "mismatch", "sigma")
    return inversion.Inversion(Controls([b.control for b in blocks]), departures.persist(), sensitivity.persist()), blocks, apri


def per_amount(rows: DataFrame, cube: api.Fluxes, species: dict[str, str]) -> DataFrame:
    """Footprints for amounts of cells and steps in place of fluxes."""
    as_flux = rows.select(F.lit("").alias("tracer"), F.col("obsid").cast("string").alias("category"), "itim", "ilat", "ilon", F.col("sensi").alias("flux"), "obsid")
    how = units.conversion(species["optimisation"], species["emission"])
    met = as_flux.join(cube.cells.select("ilat", "ilon", "area"), ["ilat", "ilon"]).join(cube.times.select("itim", "dt"), "itim")
    return met.select("obsid", "itim", "ilat", "ilon", (F.col("flux") * how.factor * F.pow("area", F.lit(how.area_power)) * F.pow("dt", F.lit(how.time_power))).alias("sensi"))


@timed
def solve(spark: SparkSession, settings: dict, land: DataFrame | None = None) -> DataFrame:
    """Runs the inversion; under the output folder and tag are apri, apos (departures), states, history and eigenvectors. Gives the states.

    The history has every point with its gradient: a run that was broken off goes through them again without transport.
    With `buckets` among the settings of the run, H is written once by so many buckets of observations.
    """
    run = settings["run"]
    folder = f"{run['paths']['output']}/{run.get('tag', 'inversion')}"
    problem, blocks, apri = setup(spark, settings, land)
    with tables.Bucketed(spark, f"{folder}/sensitivity", "obsid", run["buckets"]) if run.get("buckets") else nullcontext() as keep:
        if keep is not None:
            problem = inversion.Inversion.bucketed(problem.control, problem.departures, problem.sensitivity, keep)
        return solved(spark, run, folder, problem, blocks, apri)


def solved(spark: SparkSession, run: dict, folder: str, problem: inversion.Inversion, blocks: list[Block], apri: DataFrame) -> DataFrame:
    """Minimises a problem and writes what solve() gives into a folder."""
    apri.write.mode("overwrite").parquet(f"{folder}/apri")
    known = history(spark, f"{folder}/history")
    whole = problem.gradient

    def gradient(w: np.ndarray) -> np.ndarray:
        if w.tobytes() not in known:
            known[w.tobytes()] = whole(w)
            tables.append_states(spark, f"{folder}/history", len(known), "point", w)
            tables.append_states(spark, f"{folder}/history", len(known), "gradient", known[w.tobytes()])
        return known[w.tobytes()]

    problem.gradient = gradient
    how = run.get("optimizer", {})
    found = problem.solve(how.get("method", "lanczos"), how.get("iterations", 50), how.get("reduction", 1e6))
    problem.run(found.x, "apos").write.mode("overwrite").parquet(f"{folder}/apos")
    vectors = found.eigenvectors if found.eigenvalues is not None and len(found.eigenvalues) else np.zeros((found.x.size, 0))
    pairs = [(k, float(v), [float(x) for x in vectors[:, k]]) for k, v in enumerate(found.eigenvalues if vectors.shape[1] else [])]
    spark.createDataFrame(pairs, "k int, value double, vec array<double>").write.mode("overwrite").parquet(f"{folder}/eigenvectors")
    control = problem.control
    state = control.parts(control.to_state(found.x))
    posterior = control.parts(problem.posterior(found)) if vectors.shape[1] else [b.control.sigma for b in blocks]
    rows = [
        (b.category.tracer, b.category.name, int(t), int(p), float(b.control.sigma[t, p]), float(x[t, p]), float(s[t, p]))
        for b, x, s in zip(blocks, state, posterior, strict=True)
        for t, p in np.ndindex(x.shape)
    ]
    save_prior(blocks, f"{folder}/prior")
    states = spark.createDataFrame(rows, "tracer string, category string, itime int, ipos int, sigma_apri double, state double, sigma_apos double")
    states.write.mode("overwrite").partitionBy("tracer", "category").parquet(f"{folder}/states")
    save_fluxes(blocks, spark.read.parquet(f"{folder}/states"), folder)
    return states


def prior_and_posterior(b: Block, states: DataFrame) -> DataFrame:
    """Amounts of a category before and after (tracer, category, itim, icell, apri, apos): the state's increments by cell and step."""
    keys = ["tracer", "category", "itim", "icell"]
    own = states.filter((F.col("tracer") == b.category.tracer) & (F.col("category") == b.category.name))
    after = mapping.state_to_flux(b.amounts, own.select("tracer", "category", "itime", "ipos", "state"), b.maps.tmap, b.maps.hmap)
    nothing = F.lit(0.0)
    return b.amounts.withColumnRenamed("flux", "apri").join(after.withColumnRenamed("flux", "apos"), keys, "full").select(*keys, F.coalesce("apri", nothing).alias("apri"), F.coalesce("apos", nothing).alias("apos"))


def save_fluxes(blocks: list[Block], states: DataFrame, folder: str) -> None:
    """Amounts before and after, by tracer and category in `fluxes`, and their sums by month in `budgets`."""
    for k, b in enumerate(blocks):
        mode = "overwrite" if k == 0 else "append"
        tables.write_by(prior_and_posterior(b, states), f"{folder}/fluxes", "tracer", "category", mode=mode)
    spark = states.sparkSession
    for k, (tracer, times) in enumerate({b.category.tracer: b.times for b in blocks}.items()):
        months = times.select("itim", F.year("t0").alias("year"), F.month("t0").alias("month"))
        rows = spark.read.parquet(f"{folder}/fluxes").filter(F.col("tracer") == tracer).join(months, "itim")
        sums = rows.groupBy("tracer", "category", "year", "month").agg(F.sum("apri").alias("apri"), F.sum("apos").alias("apos"))
        tables.write_by(sums, f"{folder}/budgets", "tracer", mode="overwrite" if k == 0 else "append")


def save_prior(blocks: list[Block], path: str) -> None:
    """Errors of every element with its position and step, by tracer and category; correlations are in the categories' attributes."""
    for k, b in enumerate(blocks):
        spark = b.maps.cells.sparkSession
        sigma = spark.createDataFrame([(int(t), int(p), float(s)) for (t, p), s in np.ndenumerate(b.control.sigma)], "itime int, ipos int, sigma double")
        rows = sigma.join(b.maps.positions(), "ipos").join(b.maps.opt_axis.select(F.col("i").alias("itime"), "t0", "t1"), "itime")
        text = tables.attributes_to_text(asdict(b.category))
        named = rows.withColumns({"tracer": F.lit(b.category.tracer), "category": F.lit(b.category.name), "attributes": F.lit(text)})
        tables.write_by(named, path, "tracer", "category", mode="overwrite" if k == 0 else "append")


def history(spark: SparkSession, path: str) -> dict[bytes, np.ndarray]:
    """Gradients by point, of a run before."""
    try:
        rows = tables.states(spark, path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    by = {(r["iteration"], r["kind"]): np.array(r["vec"]) for r in rows}
    return {v.tobytes(): by[i, "gradient"] for (i, kind), v in by.items() if kind == "point" and (i, "gradient") in by}
