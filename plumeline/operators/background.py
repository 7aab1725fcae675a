"""Background concentrations at the end points of trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def height_above_ground(conc: DataFrame, by: list[str]) -> DataFrame:
    """Heights less that of the lowest level of each column of air."""
    lowest = F.first("height").over(Window.partitionBy(*by).orderBy("ilev"))
    return conc.withColumn("height_above_ground", F.col("height") - lowest)


def mid_heights(conc: DataFrame, by: list[str]) -> DataFrame:
    """The middle between each level and the next; the top level has none."""
    return conc.withColumn("mid", (F.col("height") + F.lead("height").over(Window.partitionBy(*by).orderBy("ilev"))) / 2)


def profile(conc: DataFrame) -> DataFrame:
    """One row: the levels as an array by height. For a single profile of a model's levels."""
    return conc.agg(F.array_sort(F.collect_list(F.struct("height", "value"))).alias("levels"))


def interpolated(height: Column, levels: Column) -> Column:
    """Linear between levels, and the outer levels' values beyond them."""
    below = F.filter(levels, lambda v: v["height"] <= height)
    above = F.filter(levels, lambda v: v["height"] > height)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = a["value"] + (b["value"] - a["value"]) * (height - a["height"]) / (b["height"] - a["height"])
    return F.coalesce(between, a["value"], b["value"])


def at_endpoints(endpoints: DataFrame, conc: DataFrame) -> DataFrame:
    """End points with the background value at their height; a profile of a few levels goes to all tasks."""
    return endpoints.crossJoin(F.broadcast(profile(conc))).withColumn("background", interpolated(F.col("height"), F.col("levels"))).drop("levels")


def endpoint_times(endpoints: DataFrame, origin: str) -> DataFrame:
    """End points with their time, so many seconds after the origin (before it, if negative)."""
    return endpoints.withColumn("time", F.timestamp_micros(F.unix_micros(F.lit(origin).cast("timestamp")) + (F.col("seconds") * 1_000_000).cast("long"))).drop("seconds")


def mean_background(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("obsid").agg(F.avg("background").alias("mix_background"))


def bracket(axis: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """Both neighbours on an axis (index, position) of each value, with their weights; beyond its ends the end itself."""
    places = axis.agg(F.array_sort(F.collect_list(F.struct(F.col("position"), F.col("index")))).alias("places"))
    rows = wanted.crossJoin(F.broadcast(places))
    below = F.filter("places", lambda p: p["position"] <= F.col(column))
    above = F.filter("places", lambda p: p["position"] > F.col(column))
    a = F.coalesce(F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1)))
    b = F.coalesce(F.try_element_at(above, F.lit(1)), F.try_element_at(below, F.lit(-1)))
    w = F.coalesce(F.try_divide(F.col(column) - a["position"], b["position"] - a["position"]), F.lit(0.0))
    return rows.select(*wanted.columns, F.explode(F.array(F.struct(a["index"].alias("index"), (F.lit(1.0) - w).alias("weight")), F.struct(b["index"].alias("index"), w.alias("weight")))).alias("n")).select(*wanted.columns, F.col("n.index").alias(key), F.col("n.weight").alias(f"w_{key}")).filter(f"w_{key} > 0")


def multilinear(points: DataFrame, field: DataFrame, axes: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Points (with `point`) and the field's value there: for each axis (key: the points' column, and the axis) two neighbours, then a weighted sum."""
    rows = points
    for key, (column, axis) in axes.items():
        rows = bracket(axis, column, rows, key)
    weight = F.lit(1.0)
    for key in axes:
        weight = weight * F.col(f"w_{key}")
    return rows.join(field, list(axes)).groupBy("point").agg(F.sum(weight * F.col("value")).alias("value"))


def between(points: DataFrame, axis: DataFrame, column: str, key: str) -> DataFrame:
    """Points with both neighbours on an axis (index, counted without gaps, and ascending position) of a column's value, and the upper one's weight; points beyond its ends go.

    The stretches between positions are cut at multiples of the mean stretch, and points meet
    them by the multiple they lie at: an equi-join, whatever the sizes of points and axis.
    Each stretch is open below, but for the first.
    """
    ends = axis.agg(F.min("index").alias("first"), F.max("index").alias("last"), F.min("position").alias("low"), F.max("position").alias("high"))
    mean = F.when(F.col("last") > F.col("first"), (F.col("high") - F.col("low")) / (F.col("last") - F.col("first"))).otherwise(F.lit(1.0))
    scale = F.broadcast(ends.select("first", "last", "low", mean.alias("mean")))
    place = lambda c: F.floor((c - F.col("low")) / F.col("mean"))
    lower = axis.select(F.col("index").alias("a"), F.col("position").alias("pa"))
    upper = axis.select((F.col("index") - 1).alias("a"), F.col("index").alias("b"), F.col("position").alias("pb"))
    met = lower.join(upper, "a", "left").crossJoin(scale).filter(F.col("b").isNotNull() | (F.col("first") == F.col("last")))
    whole = met.select("a", "pa", F.coalesce("b", "a").alias("b"), F.coalesce("pb", "pa").alias("pb"), "first", "low", "mean")
    stretches = whole.select("a", "pa", "b", "pb", (F.col("a") == F.col("first")).alias("closed"), F.explode(F.sequence(place(F.col("pa")), place(F.col("pb")))).alias("at"))
    value = F.col(column)
    placed = points.crossJoin(scale).withColumn("at", place(value)).drop("first", "last", "low", "mean")
    inside = ((value > F.col("pa")) | F.col("closed") & (value == F.col("pa"))) & (value <= F.col("pb"))
    found = placed.join(stretches, "at").filter(inside)
    weight = F.coalesce(F.try_divide(value - F.col("pa"), F.col("pb") - F.col("pa")), F.lit(0.0))
    return found.select(*points.columns, F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), weight.alias(f"{key}_w"))


def corners(points: DataFrame, axes: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """For each point within all axes (key: the points' column, and the axis) the corners around it: a column of indices for each key, and the corner's weight."""
    rows = points.withColumn("weight", F.lit(1.0))
    for key, (column, axis) in axes.items():
        both = between(rows, axis, column, key)
        a, b, w = (F.col(f"{key}_{x}") for x in "abw")
        ends = F.array(F.struct(a.alias("index"), (F.lit(1.0) - w).alias("share")), F.struct(b.alias("index"), w.alias("share")))
        rows = both.select(*rows.columns, F.explode(ends).alias("end")).filter("end.share > 0").withColumn("weight", F.col("weight") * F.col("end.share")).withColumn(key, F.col("end.index")).drop("end")
    return rows


def columns_at(points: DataFrame, conc: DataFrame, axes: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """point, ilev, height (above the lowest level) and value of the columns of air at points, from a field by the axes' keys and ilev."""
    above = height_above_ground(conc, list(axes)).select(*axes, "ilev", "height_above_ground", "value")
    met = corners(points.select("point", *(c for c, _ in axes.values())), axes).join(above, list(axes))
    weighted = lambda c: F.sum(F.col("weight") * F.col(c))
    return met.groupBy("point", "ilev").agg(weighted("height_above_ground").alias("height"), weighted("value").alias("value"))


def at_heights(points: DataFrame, columns: DataFrame) -> DataFrame:
    """Points (with point and height) and the background there, linear between the mid heights of their columns' layers, whose number and heights may differ, and the outer layers' values beyond them; null where there is no column."""
    mids = mid_heights(columns, ["point"]).filter("mid is not null").select("point", "mid", F.col("value").alias("layer"))
    wanted = points.select("point", F.col("height").alias("wanted")).join(mids, "point")
    level = F.struct("mid", "layer")
    ends = wanted.groupBy("point", "wanted").agg(F.max(F.when(F.col("mid") <= F.col("wanted"), level)).alias("a"), F.min(F.when(F.col("mid") > F.col("wanted"), level)).alias("b"))
    rise = (F.col("wanted") - F.col("a.mid")) / (F.col("b.mid") - F.col("a.mid"))
    found = ends.select("point", F.coalesce(F.col("a.layer") + (F.col("b.layer") - F.col("a.layer")) * rise, "a.layer", "b.layer").alias("background"))
    return points.join(found, "point", "left")


def at_trajectory_ends(endpoints: DataFrame, conc: DataFrame) -> DataFrame:
    """End points (point, lon, lat, height, time) with the background of a field (itime, time, ilat, lat, ilon, lon, ilev, height, value) there; null outside of it.

    Times may be of any spacing, and every column of air has its own heights.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    axis = lambda index, position: conc.select(F.col(index).alias("index"), position.alias("position")).distinct()
    axes = {"itime": ("seconds", axis("itime", seconds("time"))), "ilat": ("lat", axis("ilat", F.col("lat"))), "ilon": ("lon", axis("ilon", F.col("lon")))}
    points = endpoints.withColumn("seconds", seconds("time"))
    return at_heights(points, columns_at(points, conc, axes)).drop("seconds")
