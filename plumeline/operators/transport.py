"""Transport: mixing ratios from fluxes through footprints, and the adjoint.

A footprint is rows (obsid, itim, ilat, ilon, sensi), unique by the first four, so both
directions are one equi-join and one sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["itim", "ilat", "ilon"]


def unique_footprints(footprints: DataFrame) -> DataFrame:
    """Sensitivities added up where a footprint has a cell and time twice."""
    return footprints.groupBy("obsid", *CELL).agg(F.sum("sensi").alias("sensi"))


def forward(obs: DataFrame, footprints: DataFrame, flux: DataFrame) -> DataFrame:
    """obsid, category, mix: fluxes of the observation's tracer weighted with its footprint; 0 where they don't meet.

    Fluxes and footprints meet first, and the join carries keys and two numbers; observations
    with a footprint bring the categories of their tracer.
    """
    seen = obs.select("obsid", "tracer").join(footprints.select("obsid").distinct(), "obsid", "left_semi")
    met = footprints.join(obs.select("obsid", "tracer"), "obsid").join(flux.select("tracer", "category", *CELL, "flux"), ["tracer", *CELL])
    sums = met.groupBy("obsid", "category").agg(F.sum(F.col("flux") * F.col("sensi")).alias("mix"))
    every = seen.join(flux.select("tracer", "category").distinct(), "tracer").select("obsid", "category")
    return every.join(sums, ["obsid", "category"], "left").select("obsid", "category", F.coalesce("mix", F.lit(0.0)).alias("mix"))


def total(obs: DataFrame, mixes: DataFrame) -> DataFrame:
    """Observations with mix_foreground (sum of categories) and mix (with the background, 0 where it is missing)."""
    sums = mixes.groupBy("obsid").agg(F.sum("mix").alias("mix_foreground"))
    return obs.join(sums, "obsid", "left").withColumn("mix", F.coalesce("mix_background", F.lit(0.0)) + F.col("mix_foreground"))


def departures(modelled: DataFrame, error: str = "err_obs") -> DataFrame:
    """obsid, mix_foreground, mismatch (modelled less observed) and sigma, where both are known."""
    rows = modelled.select("obsid", (F.col("mix") - F.coalesce("mix_background", F.lit(0.0))).alias("mix_foreground"), (F.col("mix") - F.col("obs")).alias("mismatch"), F.col(error).alias("sigma"))
    return rows.dropna(subset=["mismatch", "sigma"])


def adjoint(departures: DataFrame, footprints: DataFrame) -> DataFrame:
    """tracer, itim, ilat, ilon, adj: departures (obsid, tracer, dy) spread over their footprints; partial sums come before the shuffle."""
    return adjoint_of(departures.select("obsid", "tracer", "dy"), footprints)


def adjoint_of(departures: DataFrame, footprints: DataFrame) -> DataFrame:
    """The adjoint where either table has the tracer."""
    return footprints.join(departures.filter("dy is not null"), "obsid").groupBy("tracer", *CELL).agg(F.sum(F.col("dy") * F.col("sensi")).alias("adj"))


def adjoint_by_category(departures: DataFrame, footprints: DataFrame, categories: DataFrame) -> DataFrame:
    """The adjoint for every category (tracer, category): by linearity the same for each."""
    return adjoint(departures, footprints).join(categories.select("tracer", "category"), "tracer")


def sensitivity(obs: DataFrame, footprints: DataFrame) -> DataFrame:
    """tracer, ilat, ilon, sensi: what all observations together see."""
    return footprints.join(obs.select("obsid", "tracer"), "obsid").groupBy("tracer", "ilat", "ilon").agg(F.sum("sensi").alias("sensi"))


def adjoint_test(obs: DataFrame, footprints: DataFrame, flux: DataFrame) -> DataFrame:
    """<Hx, y> and <x, H'y> with y = obs, over fluxes x; equal but for rounding."""
    hx = forward(obs, footprints, flux).groupBy("obsid").agg(F.sum("mix").alias("hx"))
    left = hx.join(obs.select("obsid", "obs"), "obsid").agg(F.sum(F.col("hx") * F.col("obs")).alias("hx_y"))
    back = adjoint(obs.select("obsid", "tracer", F.col("obs").alias("dy")), footprints)
    right = back.join(flux, ["tracer", *CELL]).agg(F.sum(F.col("adj") * F.col("flux")).alias("x_hty"))
    return left.join(F.broadcast(right)).withColumn("difference", F.lit(1.0) - F.col("hx_y") / F.col("x_hty"))
