"""Objects around the operators: observations, fluxes, mapping, prior, transport and optimiser of one inversion."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions import expressions, units
from plumeline.operators import clusters, flux, mapping, observations, prior, solver, transport
from plumeline.operators.grid import Grid
from plumeline.plans import inversion
from plumeline.sources import tables


@dataclass(frozen=True)
class Observations:
    """Observations, their sites, and how their errors are made. Every method gives a new object."""

    obs: DataFrame
    sites: DataFrame
    settings: observations.ErrorSettings = observations.ErrorSettings()

    @classmethod
    def from_table(cls, table: DataFrame, key: str = "site") -> Observations:
        return cls(*observations.split_table(table, key))

    @classmethod
    def from_tar(cls, spark: SparkSession, path: str, obs_schema: str, site_schema: str) -> Observations:
        return cls(*tables.observations_from_tar(spark, path, obs_schema, site_schema))

    def save_tar(self, path: str) -> None:
        tables.observations_to_tar(self.obs, self.sites, path)

    def to_table(self) -> DataFrame:
        return observations.flat_table(self.obs, self.sites)

    def write(self, path: str) -> None:
        self.to_table().write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "site") -> Observations:
        """What write() wrote: one flat table, split into observations and sites."""
        return cls.from_table(spark.read.parquet(path), key)

    def select_times(self, tmin: str | None = None, tmax: str | None = None) -> Observations:
        """In the closed range, with the sites that still have observations."""
        kept = observations.select_times(self.obs, tmin, tmax)
        return replace(self, obs=kept, sites=observations.sites_with_observations(self.sites, kept))

    def select_sites(self, codes: list[str]) -> Observations:
        return replace(self, obs=observations.select_sites(self.obs, codes), sites=observations.select_sites(self.sites, codes))

    def in_hours(self, start: str = "assim_start", end: str = "assim_end") -> Observations:
        return replace(self, obs=observations.in_hours(self.obs, self.sites, start, end))

    def with_errors(self, model: str = "mix_apri", **settings: Any) -> Observations:
        """With err, from observation errors and what detrended model and observations differ by."""
        made = self.settings.update(**settings)
        return replace(self, obs=observations.inflated_errors(self.obs, made, model), settings=made)

    def departures(self, value: str = "mismatch", error: str = "err") -> DataFrame:
        return observations.complete(self.obs, value, error)


@dataclass(frozen=True)
class Category:
    """What is known of a category: whether it is transported (and was tagged so, whatever combination it is part of) and optimised, its unit, its error's shape, and if it is a combination, of what."""

    name: str
    tracer: str
    unit: str = ""
    transported: bool = True
    tagged: bool = False
    optimised: bool = False
    combination: str | None = None
    horizontal: str = "500-e"
    temporal: float = 30.0
    target: float | None = None


@dataclass(frozen=True)
class Fluxes:
    """A flux cube with its cells, steps and categories."""

    flux: DataFrame
    cells: DataFrame
    times: DataFrame
    categories: tuple[Category, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.flux.sparkSession

    def table(self) -> DataFrame:
        rows = [(c.tracer, c.name, c.transported, c.optimised, c.combination is not None) for c in self.categories]
        return self.spark.createDataFrame(rows, "tracer string, category string, transported boolean, optimised boolean, meta boolean")

    def add(self, category: Category, rows: DataFrame | float = 0.0) -> Fluxes:
        """One more category. The parts of a combination aren't transported any more, unless they are tagged so."""
        if not category.combination:
            return replace(self, flux=flux.with_category(self.flux, category.name, rows), categories=(*self.categories, category))
        parts = expressions.terms(category.combination)
        others = tuple(replace(c, transported=c.tagged) if c.name in parts and c.tracer == category.tracer else c for c in self.categories)
        return replace(self, categories=(*others, category))

    def resolve(self) -> Fluxes:
        """Combinations evaluated, under their names."""
        definitions = {c.name: c.combination for c in self.categories if c.combination}
        made = flux.metacategories(self.flux, expressions.terms_table(self.spark, definitions)) if definitions else self.flux.limit(0)
        return replace(self, flux=self.flux.select(*flux.KEY, "flux").unionByName(made.select(*flux.KEY, "flux")))

    def transported(self) -> Fluxes:
        return replace(self, flux=flux.chosen(self.flux, self.table(), "transported"))

    def convert(self, source: str, target: str) -> Fluxes:
        return replace(self, flux=flux.in_unit(self.flux, self.cells, self.times, source, target))

    def to_extensive(self) -> Fluxes:
        return replace(self, flux=flux.to_extensive(self.flux, self.cells, self.times))

    def to_intensive(self) -> Fluxes:
        return replace(self, flux=flux.to_intensive(self.flux, self.cells, self.times))

    def resample(self, period: str, unit: str) -> DataFrame:
        """Sums or means over a column of the cube, as the unit asks."""
        return flux.resampled(self.flux, period, "sum" if units.is_extensive(unit) else "avg")

    def budget(self, tracer: str) -> DataFrame:
        """Totals of a tracer's fluxes in its budget's unit, by category, year and month."""
        own = units.species(tracer)
        rows = self.flux.filter(F.col("tracer") == tracer)
        return flux.budget(flux.in_unit(rows, self.cells, self.times, own["emission"], own["budget"]), self.times)

    def zeros(self, value: float = 0.0) -> Fluxes:
        return replace(self, flux=flux.filled_like(self.flux, value))

    def as_vector(self, category: str) -> DataFrame:
        """k, flux of one category: places in the order of steps, rows and columns of the whole grid; where there is no flux, there is no row."""
        shape = self.cells.agg((F.max("ilat") + 1).alias("nlat"), (F.max("ilon") + 1).alias("nlon"))
        k = (F.col("itim").cast("long") * F.col("nlat") + F.col("ilat")) * F.col("nlon") + F.col("ilon")
        return self.flux.filter(F.col("category") == category).crossJoin(F.broadcast(shape)).select("tracer", k.alias("k"), "flux")

    def write(self, path: str, only_transported: bool = False) -> None:
        """The cube by tracer and category, and beside it cells (with areas), steps and what is known of categories."""
        kept = self.transported() if only_transported else self
        tables.write_flux(kept.flux, f"{path}/flux")
        self.cells.write.parquet(f"{path}/cells")
        self.times.write.parquet(f"{path}/times")
        known = [c for c in self.categories if c.transported or not only_transported]
        self.spark.createDataFrame([(c.tracer, c.name, tables.attributes_to_text(asdict(c))) for c in known], "tracer string, category string, attributes string").write.parquet(f"{path}/categories")

    @classmethod
    def read(cls, spark: SparkSession, path: str, tracers: list[str] | None = None) -> Fluxes:
        """What write() wrote, or some tracers of it."""
        rows = spark.read.parquet(f"{path}/categories").orderBy("tracer", "category").collect()
        known = tuple(Category(**tables.attributes_from_text(r["attributes"])) for r in rows if tracers is None or r["tracer"] in tracers)
        return cls(tables.read_flux(spark, f"{path}/flux", tracers), spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/times"), known)


@dataclass
class Transport:
    """Footprints, and what is done with them."""

    footprints: DataFrame

    def forward(self, obs: DataFrame, fluxes: DataFrame) -> DataFrame:
        return transport.total(obs, transport.forward(obs, self.footprints, fluxes))

    def departures(self, obs: DataFrame, fluxes: DataFrame, error: str = "err_obs") -> DataFrame:
        return transport.departures(self.forward(obs, fluxes), error)

    def adjoint(self, departures: DataFrame) -> DataFrame:
        return transport.adjoint(departures, self.footprints)

    def sensitivity(self, obs: DataFrame) -> DataFrame:
        return transport.sensitivity(obs, self.footprints)

    def adjoint_test(self, obs: DataFrame, fluxes: DataFrame) -> float:
        return transport.adjoint_test(obs, self.footprints, fluxes).first()["difference"]


@dataclass
class Mapping:
    """Between the model's cells and steps and those of the state. cells have icell, bounds, area and land_fraction; axes i, t0 and t1."""

    cells: DataFrame
    model_axis: DataFrame
    opt_axis: DataFrame
    hmap: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.tmap = mapping.temporal(self.model_axis, self.opt_axis)
        self.hmap = mapping.native_cells(self.cells, None)

    def by_clusters(self, n: int, value: str, mask: str | None = None) -> Mapping:
        """Positions are at most about n clusters of cells, balanced by a column of the cells."""
        self.hmap = mapping.clusters_of(clusters.cluster_rows(self.cells, n, value, mask))
        return self

    def on_land(self, least: float = 0.0) -> Mapping:
        """Positions are the cells with land."""
        self.hmap = mapping.native_cells(self.cells, least)
        return self

    def control(self, fluxes: DataFrame) -> DataFrame:
        return mapping.coarsened(fluxes, self.tmap, self.hmap)

    def positions(self) -> DataFrame:
        return mapping.cluster_attributes(self.cells, self.hmap)

    def to_flux(self, fluxes: DataFrame, state: DataFrame) -> DataFrame:
        return mapping.state_to_flux(fluxes, state, self.tmap, self.hmap)

    def adjoint(self, adjoint: DataFrame) -> DataFrame:
        return mapping.flux_to_state_adjoint(adjoint, self.tmap, self.hmap)

    def sensitivity(self, obs: DataFrame, footprints: DataFrame, n_lon: int) -> DataFrame:
        """What observations see of the state's elements: obsid, itime, ipos, h."""
        return inversion.state_sensitivity(obs, footprints, self.tmap, self.hmap, n_lon)


@dataclass
class Prior:
    """Errors and correlations of one category's state of n_time steps, dt apart, and positions (ipos, lat, lon)."""

    category: Category
    positions: DataFrame
    n_time: int
    dt: float

    def roots(self, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the correlations in time and in space; with a folder, the latter is kept there."""
        length, kind = prior.kernel_and_length(self.category.horizontal)
        places = self.positions.select("ipos", "lat", "lon").orderBy("ipos").collect()
        d = prior.distance_matrix(np.array([r["lat"] for r in places]), np.array([r["lon"] for r in places]))
        in_space = prior.cached_root(prior.ARRAY_KERNELS[kind](d, length), self.positions.sparkSession, folder)
        lag = np.abs(np.subtract.outer(np.arange(self.n_time), np.arange(self.n_time)))
        return prior.temporal_root(np.exp(-lag * self.dt / self.category.temporal)), in_space

    def control(self, sigma: np.ndarray, folder: str | None = None) -> inversion.Control:
        """With errors (times by positions), scaled to the category's target where it has one."""
        in_time, in_space = self.roots(folder)
        if self.category.target is not None:
            total = np.sqrt((((in_time @ in_time.T) @ sigma @ (in_space @ in_space.T)) * sigma).sum())
            sigma = sigma * (self.category.target * self.n_time * self.dt / 365.25 / total)
        return inversion.Control(sigma, in_time, in_space)


@dataclass
class Optimizer:
    """A problem, and what its solution says."""

    problem: inversion.Inversion
    found: solver.Solution | None = None

    def solve(self, method: str = "lanczos", iterations: int = 50, reduction: float = 1e6) -> np.ndarray:
        self.found = self.problem.solve(method, iterations, reduction)
        return self.problem.control.to_state(self.found.x)

    def posterior(self) -> np.ndarray:
        return self.problem.posterior(self.found)

    def chi2(self) -> float:
        rows = solver.observation_cost(self.problem.recent(self.found.x))
        return solver.reduced_chi2(rows, self.found.iterations).first()["chi2"]

    def gradient_test(self) -> list[tuple[float, float]]:
        return solver.gradient_test(self.problem.cost, self.problem.gradient, np.ones(self.problem.control.sigma.size))


def cells_of(spark: SparkSession, grid: Grid, land: DataFrame | None = None) -> DataFrame:
    """A grid's cells, with the land fractions of a table (ilat, ilon, land_fraction), or 1."""
    cells = grid.cells(spark)
    if land is None:
        return cells.withColumn("land_fraction", F.lit(1.0))
    return cells.join(F.broadcast(land), ["ilat", "ilon"], "left").withColumn("land_fraction", F.coalesce("land_fraction", F.lit(0.0)))
