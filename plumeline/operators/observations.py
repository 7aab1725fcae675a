"""Observations and sites: selection, mapping columns, error model.

Observations have obsid, time, site or code, and values; sites have one row each. Both
are DataFrames; nothing here needs more of them than the columns it names.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.checks import checked
from plumeline.functions.timeaxis import step


@dataclass(frozen=True)
class ErrorSettings:
    """How observation errors are made."""

    err_min: float = 0.0
    err_freq: str = "7D"
    err_fac: float = 1.0
    field_err_obs: str = "err_obs"

    def update(self, **values: Any) -> ErrorSettings:
        """A copy with the known ones among the values."""
        return replace(self, **{f.name: values[f.name] for f in fields(self) if f.name in values})


def select_times(obs: DataFrame, tmin: str | None = None, tmax: str | None = None) -> DataFrame:
    """Rows in the closed range; without a bound, all on that side."""
    out = obs
    if tmin is not None:
        out = out.filter(F.col("time") >= F.lit(tmin).cast("timestamp"))
    if tmax is not None:
        out = out.filter(F.col("time") <= F.lit(tmax).cast("timestamp"))
    return out


def select_sites(obs: DataFrame, codes: list[str]) -> DataFrame:
    return obs.filter(F.col("code").isin(codes))


def sites_with_observations(sites: DataFrame, obs: DataFrame, key: str = "site") -> DataFrame:
    return sites.join(obs.select(key), key, "left_semi")


def time_bounds(obs: DataFrame) -> DataFrame:
    return obs.agg(F.min("time").alias("tmin"), F.max("time").alias("tmax"))


def in_hours(obs: DataFrame, sites: DataFrame, start: str = "assim_start", end: str = "assim_end") -> DataFrame:
    """Rows whose hour is in their site's range, both ends included; a range may go over midnight."""
    hour, a, b = F.hour("time"), F.col(start), F.col(end)
    inside = F.when(a > b, (hour >= a) | (hour <= b)).otherwise(hour.between(a, b))
    return obs.join(sites.select("site", start, end), "site").filter(inside).drop(start, end)


def complete(obs: DataFrame, value: str = "mismatch", error: str = "err") -> DataFrame:
    """obsid, mismatch and sigma where neither is null."""
    return obs.select("obsid", F.col(value).alias("mismatch"), F.col(error).alias("sigma")).dropna(subset=["mismatch", "sigma"])


def with_driver(obs: DataFrame, column: str = "dy") -> DataFrame:
    """Rows that an adjoint run can start from."""
    return obs.filter(F.col(column).isNotNull())


def floor_errors(obs: DataFrame, settings: ErrorSettings = ErrorSettings()) -> DataFrame:
    """Unknown errors (zero or less) become the least error."""
    e = settings.field_err_obs
    return obs.withColumn(e, F.when(F.col(e) <= 0, F.lit(settings.err_min)).otherwise(F.col(e)))


def rolling_means(obs: DataFrame, settings: ErrorSettings = ErrorSettings(), model: str = "mix_apri") -> DataFrame:
    """Means of observed and modelled values over the window that ends at each row, by code, weighted with 1 / error squared.

    The window is open at its start. An error of zero has no finite weight: the row has none. Each code is cut into blocks of
    time as long as the window, so that a code with many rows is many groups. A window is the first rows of its own block and the
    last ones of the block before, which leave it at their time and a width: both are running sums, in order of time and against
    it, so that a row costs the same however many a window has, and no sum is taken from another. The order of a sum's terms
    hardly shows in it.
    """
    width = step(settings.err_freq).seconds * 1_000_000
    rows = floor_errors(obs, settings).withColumn("weight", F.try_divide(F.lit(1.0), F.col(settings.field_err_obs) * F.col(settings.field_err_obs)))
    rows = rows.withColumn("_at", F.unix_micros(F.col("time").cast("timestamp"))).withColumn("_block", F.floor(F.col("_at") / width))
    rows = rows.withColumns({"_obs": F.col("obs") * F.col("weight"), "_mod": F.col(model) * F.col("weight")})
    copies = F.when(F.col("_at").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))  # values are made before it, once
    rows = rows.withColumn("_ahead", F.explode(copies)).withColumns({"_block": F.col("_block") + F.col("_ahead"), "_at": F.col("_at") + F.col("_ahead") * width})
    group = Window.partitionBy("code", "_block")
    entered = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    staying = group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)

    def running(value: Column) -> Column:
        own, before = F.sum(F.when(F.col("_ahead") == 0, value)).over(entered), F.sum(F.when(F.col("_ahead") == 1, value)).over(staying)
        return F.coalesce(own + before, own, before)

    def total(value: Column) -> Column:
        """The sum of the values' first 24 bits, which is exact for values of like sizes, and that of what is left."""
        high = value.cast("float").cast("double")
        high = F.when(F.abs(high) < F.lit(3e38), high).otherwise(value)
        return running(high) + running(F.when(high == value, F.lit(0.0)).otherwise(value - high))

    def mean(name: str) -> Column:
        return F.try_divide(total(F.col(f"_{name}")), total(F.when(F.col(f"_{name}").isNotNull(), F.col("weight"))))

    return rows.withColumns({"obs_rolling": mean("obs"), "mod_rolling": mean("mod")}).filter("_ahead = 0").drop("_at", "_block", "_ahead", "_obs", "_mod")


def residuals(obs: DataFrame, settings: ErrorSettings = ErrorSettings(), model: str = "mix_apri") -> DataFrame:
    rows = rolling_means(obs, settings, model)
    return rows.withColumns({"resid_obs": F.col("obs") - F.col("obs_rolling"), "resid_mod": F.col(model) - F.col("mod_rolling")})


def model_errors(obs: DataFrame, settings: ErrorSettings = ErrorSettings(), model: str = "mix_apri") -> DataFrame:
    """The standard deviation of what detrended observations and model differ by, of each code."""
    return residuals(obs, settings, model).groupBy("code").agg(F.stddev_pop(F.col("resid_obs") - F.col("resid_mod")).alias("sigma"))


def inflated_errors(obs: DataFrame, settings: ErrorSettings = ErrorSettings(), model: str = "mix_apri") -> DataFrame:
    """Observations with err: their own error and their code's model error, squared and added, times err_fac."""
    spread = model_errors(obs, settings, model).withColumnRenamed("sigma", "_spread")
    rows = residuals(obs, settings, model).join(spread, "code", "left")
    own, more = F.col(settings.field_err_obs), F.col("_spread")
    return rows.withColumns({"obs_detrended": F.col("resid_obs"), "mod_detrended": F.col("resid_mod"), "err": F.sqrt(own * own + more * more) * settings.err_fac}).drop("_spread")


def constant_columns(table: DataFrame, key: str = "site") -> list[str]:
    """Columns that have one value (or none) for each key, over the whole table."""
    others = [c for c in table.columns if c != key]
    values = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in others]
    most = table.groupBy(key).agg(*values).agg(*[F.max(c).alias(c) for c in others]).first()
    return [c for c in others if (most[c] or 0) <= 1]


def split_table(table: DataFrame, key: str = "site") -> tuple[DataFrame, DataFrame]:
    """Observations and sites of a flat table: columns that are constant for every site are the sites'."""
    own = constant_columns(table, key)
    return table.drop(*own), table.select(key, *own).groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in own])


def flat_table(obs: DataFrame, sites: DataFrame, key: str = "site") -> DataFrame:
    """Observations with the columns of their sites that they don't have."""
    return obs.join(sites.select(key, *[c for c in sites.columns if c not in obs.columns]), key, "left")


def footprint_files(obs: DataFrame) -> DataFrame:
    """Observations with the name of the file that their footprint would be in."""
    return obs.withColumn("footprint", F.concat(F.lower("code"), F.format_string(".%.0fm.", F.col("height")), F.date_format("time", "yyyy-MM"), F.lit(".hdf")))


def observation_ids(obs: DataFrame) -> DataFrame:
    """Observations with an id made of code, height and time, where they have a footprint."""
    made = F.concat(F.col("code"), F.format_string(".%.0fm.", F.col("height")), F.date_format("time", "yyyyMMdd-HHmmss"))
    return obs.withColumn("fp_id", F.when(F.col("footprint").isNotNull(), made))


def only_existing(obs: DataFrame, catalog: DataFrame, column: str, key: str, required: bool = False) -> DataFrame:
    """`column` is null where the catalog has no such key; with `required`, computing the rows is an error if none has one."""
    there = catalog.select(F.col(key).alias("_there")).distinct()
    found = obs.join(there, F.col(column) == F.col("_there"), "left").withColumn(column, F.col("_there")).drop("_there")
    if not required:
        return found
    some = checked(found.agg(F.count(column).alias("_n")), F.col("_n") > 0, "no footprint file found")
    return found.crossJoin(F.broadcast(some)).drop("_n")


def file_counts(obs: DataFrame, column: str = "footprint") -> DataFrame:
    """Observations of each file, most first."""
    return obs.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def merge_background(obs: DataFrame, background: DataFrame, column: str = "mix_background") -> DataFrame:
    """Observations with a background's values where it has some."""
    new = background.select("obsid", F.col(column).alias("_new"))
    return obs.join(new, "obsid", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def renamed(obs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Observations with copies of columns under other names: new name by old."""
    return obs.withColumns({new: F.col(old) for old, new in names.items()})
