"""Flux cubes as rows (tracer, category, itim, ilat, ilon, flux): resampling, filling, units, budgets, meta-categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.timeaxis import Step
from plumeline.functions.units import Conversion, conversion

KEY = ["tracer", "category", "itim", "ilat", "ilon"]


def half_open(rows: DataFrame, start: int, end: int, column: str = "itim") -> DataFrame:
    return rows.filter((F.col(column) >= start) & (F.col(column) < end))


def resampled(flux: DataFrame, period: str, how: str = "sum") -> DataFrame:
    """Fluxes of longer steps, given by a column of the rows: sums of extensive ones (`sum`), means of intensive ones (`avg`)."""
    if how not in ("sum", "avg"):
        raise ValueError("sum or avg")
    return flux.groupBy("tracer", "category", period, "ilat", "ilon").agg(getattr(F, how)("flux").alias("flux"))


def without_null(flux: DataFrame) -> DataFrame:
    return flux.withColumn("flux", F.coalesce("flux", F.lit(0.0)))


def dense(flux: DataFrame, times: DataFrame, cells: DataFrame) -> DataFrame:
    """Every category at every time and cell, 0 where there was no row; axes are small and go to all tasks."""
    axes = flux.select("tracer", "category").distinct().crossJoin(F.broadcast(times.select("itim"))).crossJoin(F.broadcast(cells.select("ilat", "ilon")))
    return without_null(axes.join(flux, KEY, "left"))


def steps_within(source: Step, target: Step) -> int:
    """How many target steps a source step has; it must be a whole number."""
    n = source.ratio(target)
    if n != int(n):
        raise ValueError("the steps aren't whole parts of each other")
    return int(n)


def upsampled(flux: DataFrame, times: DataFrame) -> DataFrame:
    """Fluxes at all times: each from the last one before or at it, 0 before the first."""
    series = ["tracer", "category", "ilat", "ilon"]
    axes = flux.select(*series).distinct().crossJoin(F.broadcast(times.select("itim")))
    so_far = Window.partitionBy(*series).orderBy("itim").rowsBetween(Window.unboundedPreceding, 0)
    rows = axes.join(flux, KEY, "left")
    return rows.select(*KEY, F.coalesce(F.last("flux", ignorenulls=True).over(so_far), F.lit(0.0)).alias("flux"))


def converted(flux: DataFrame, cells: DataFrame, times: DataFrame, how: Conversion) -> DataFrame:
    """Fluxes in another unit; areas and steps are joined only where the conversion needs them."""
    rows, value = flux, F.col("flux") * how.factor
    if how.area_power:
        rows = rows.join(cells.select("ilat", "ilon", "area"), ["ilat", "ilon"])
        value = value * F.col("area") if how.area_power > 0 else value / F.col("area")
    if how.time_power:
        rows = rows.join(times.select("itim", "dt"), "itim")
        value = value * F.col("dt") if how.time_power > 0 else value / F.col("dt")
    return rows.select(*KEY, value.alias("flux"))


def to_extensive(flux: DataFrame, cells: DataFrame, times: DataFrame) -> DataFrame:
    """Amounts a cell and step from fluxes per area and second."""
    return converted(flux, cells, times, Conversion(1.0, 1, 1))


def to_intensive(flux: DataFrame, cells: DataFrame, times: DataFrame) -> DataFrame:
    """Fluxes per area and second from amounts; the adjoint of the same is the same division."""
    return converted(flux, cells, times, Conversion(1.0, -1, -1))


def in_unit(flux: DataFrame, cells: DataFrame, times: DataFrame, source: str, target: str) -> DataFrame:
    return converted(flux, cells, times, conversion(source, target))


def budget(flux: DataFrame, times: DataFrame) -> DataFrame:
    """Totals of each tracer and category by the month and year that each step (itim, t0) begins in, and in all; year and month are null in totals over them."""
    steps = flux.groupBy("tracer", "category", "itim").agg(F.sum("flux").alias("part"))
    rows = steps.join(times.select("itim", F.year("t0").alias("year"), F.month("t0").alias("month")), "itim")
    months = rows.groupBy("tracer", "category", "year", "month").agg(F.sum("part").alias("part"))
    return months.rollup("tracer", "category", "year", "month").agg(F.sum("part").alias("total"))


def metacategories(flux: DataFrame, terms: DataFrame) -> DataFrame:
    """Linear combinations of categories, cell by cell; `terms` (meta, category, coeff) is small."""
    sums = flux.join(F.broadcast(terms), "category").groupBy("tracer", "meta", "itim", "ilat", "ilon").agg(F.sum(F.col("coeff") * F.col("flux")).alias("flux"))
    return sums.withColumnRenamed("meta", "category").select(*KEY, "flux")


def resolved(flux: DataFrame, terms: DataFrame) -> DataFrame:
    """Categories and their combinations, these as `_name`."""
    made = metacategories(flux, terms).withColumn("category", F.concat(F.lit("_"), F.col("category")))
    return flux.select(*KEY, "flux").unionByName(made)


def filled_like(flux: DataFrame, value: float = 0.0) -> DataFrame:
    return flux.withColumn("flux", F.lit(value))


def with_category(flux: DataFrame, category: str, rows: DataFrame | float) -> DataFrame:
    """One more category: rows (tracer, itim, ilat, ilon, flux), or a number at all places of each tracer."""
    if not isinstance(rows, DataFrame):
        rows = flux.select("tracer", "itim", "ilat", "ilon").distinct().withColumn("flux", F.lit(float(rows)))
    return flux.select(*KEY, "flux").unionByName(rows.withColumn("category", F.lit(category)).select(*KEY, "flux"))


def chosen(flux: DataFrame, categories: DataFrame, flag: str) -> DataFrame:
    """Fluxes of the categories (tracer, category) that have a flag: optimized, transported, meta ..."""
    return flux.join(F.broadcast(categories.filter(F.col(flag)).select("tracer", "category")), ["tracer", "category"], "left_semi")


def bounds(flux: DataFrame, cells: DataFrame) -> DataFrame:
    """One row for each tracer: first and last step, and the area that its fluxes lie in."""
    rows = flux.join(cells.select("ilat", "ilon", "lat_s", "lat_n", "lon_w", "lon_e"), ["ilat", "ilon"])
    return rows.groupBy("tracer").agg(F.min("itim").alias("first"), F.max("itim").alias("last"), F.min("lat_s").alias("lat_s"), F.max("lat_n").alias("lat_n"), F.min("lon_w").alias("lon_w"), F.max("lon_e").alias("lon_e"))


def nonzero(rows: DataFrame, value: str = "flux") -> DataFrame:
    return rows.filter(F.col(value) != 0)
