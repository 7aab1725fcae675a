"""Between the model's axes and those of the optimisation: sparse matrices as rows.

tmap (itim_opt, itim_mod, frac) has the share of each optimisation step that a model
step covers, with sum 1 over the model steps; hmap (icell, ipos, frac) shares a cluster
among its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.timeaxis import overlap_share


def temporal(model: DataFrame, opt: DataFrame) -> DataFrame:
    """tmap of two axes (i, t0, t1 as numbers). Steps meet in buckets as long as the longest step, so the join is an equi-join."""
    width = F.max(F.col("t1") - F.col("t0"))
    size = F.broadcast(model.select("t0", "t1").unionByName(opt.select("t0", "t1")).agg(width.alias("w")))

    def bucketed(axis: DataFrame, name: str) -> DataFrame:
        low, high = F.floor(F.col("t0") / F.col("w")), F.floor(F.col("t1") / F.col("w"))
        return axis.crossJoin(size).select(F.col("i").alias(name), F.col("t0").alias(f"{name}_0"), F.col("t1").alias(f"{name}_1"), F.col("w"), F.explode(F.sequence(low, high)).alias("bucket"))

    m, o = bucketed(model, "itim_mod"), bucketed(opt, "itim_opt").drop("w")
    both = m.join(o, "bucket").filter((F.col("itim_mod_0") < F.col("itim_opt_1")) & (F.col("itim_mod_1") > F.col("itim_opt_0")))
    both = both.filter(F.floor(F.greatest("itim_mod_0", "itim_opt_0") / F.col("w")) == F.col("bucket"))
    share = overlap_share(F.col("itim_mod_0"), F.col("itim_mod_1"), F.col("itim_opt_0"), F.col("itim_opt_1"))
    rows = both.select("itim_opt", "itim_mod", share.alias("part")).filter("part > 0")
    return rows.select("itim_opt", "itim_mod", (F.col("part") / F.sum("part").over(Window.partitionBy("itim_opt"))).alias("frac"))


def clusters_of(members: DataFrame) -> DataFrame:
    """hmap of rows (icell, ipos): each cell has an equal share of its cluster."""
    return members.select("icell", "ipos", (F.lit(1.0) / F.count("*").over(Window.partitionBy("ipos"))).alias("frac"))


def native_cells(cells: DataFrame, minimum: float | None = 0.0) -> DataFrame:
    """hmap in which each cell with land (or each, without a minimum) is a cluster of its own."""
    kept = cells if minimum is None else cells.filter(F.col("land_fraction") > minimum)
    order = Window.orderBy("icell")
    return kept.select("icell", (F.row_number().over(order) - 1).alias("ipos"), F.lit(1.0).alias("frac"))


def coarsened(flux: DataFrame, tmap: DataFrame, hmap: DataFrame) -> DataFrame:
    """tracer, category, itime, ipos, state: sums over the member steps and cells, by membership and not by share; flux has icell."""
    first = flux.join(hmap.select("icell", "ipos"), "icell").groupBy("tracer", "category", "itim", "ipos").agg(F.sum("flux").alias("flux"))
    second = first.join(tmap.select(F.col("itim_mod").alias("itim"), "itim_opt"), "itim")
    return second.groupBy("tracer", "category", F.col("itim_opt").alias("itime"), "ipos").agg(F.sum("flux").alias("state"))


def over_time(state: DataFrame, tmap: DataFrame, keys: list[str]) -> DataFrame:
    """State by optimisation step dealt to model steps."""
    return state.join(tmap, state["itime"] == tmap["itim_opt"]).groupBy(*keys, "itim_mod").agg(F.sum(F.col("state") * F.col("frac")).alias("value"))


def over_time_adjoint(value: DataFrame, tmap: DataFrame, keys: list[str]) -> DataFrame:
    return value.join(tmap, "itim_mod").groupBy(*keys, F.col("itim_opt").alias("itime")).agg(F.sum(F.col("value") * F.col("frac")).alias("state"))


def over_space(state: DataFrame, hmap: DataFrame, keys: list[str]) -> DataFrame:
    """State by cluster dealt to cells."""
    return state.join(hmap, "ipos").groupBy(*keys, "icell").agg(F.sum(F.col("state") * F.col("frac")).alias("value"))


def over_space_adjoint(value: DataFrame, hmap: DataFrame, keys: list[str]) -> DataFrame:
    return value.join(hmap, "icell").groupBy(*keys, "ipos").agg(F.sum(F.col("value") * F.col("frac")).alias("state"))


def cluster_attributes(cells: DataFrame, hmap: DataFrame) -> DataFrame:
    """Area, and area means of position and land, of each cluster."""
    mean = lambda c: (F.sum(F.col(c) * F.col("area")) / F.sum("area"))
    rows = cells.withColumns({"lat": (F.col("lat_s") + F.col("lat_n")) / 2, "lon": (F.col("lon_w") + F.col("lon_e")) / 2})
    return rows.join(hmap, "icell").groupBy("ipos").agg(mean("lat").alias("lat"), mean("lon").alias("lon"), mean("land_fraction").alias("land_fraction"), F.sum("area").alias("area"))


def control_axes(positions: DataFrame, times: DataFrame) -> DataFrame:
    """Every position at every optimisation step."""
    return positions.crossJoin(F.broadcast(times))


def state_to_flux(prior: DataFrame, state: DataFrame, tmap: DataFrame, hmap: DataFrame) -> DataFrame:
    """Prior amounts (tracer, category, itim, icell, flux) plus the state's increments."""
    keys = ["tracer", "category"]
    spread = over_space(over_time(state, tmap, [*keys, "ipos"]).select(*keys, "ipos", "itim_mod", F.col("value").alias("state")), hmap, [*keys, "itim_mod"])
    more = spread.select(*keys, F.col("itim_mod").alias("itim"), "icell", F.col("value").alias("flux"))
    return prior.select(*keys, "itim", "icell", "flux").unionByName(more).groupBy(*keys, "itim", "icell").agg(F.sum("flux").alias("flux"))


def flux_to_state_adjoint(adjoint: DataFrame, tmap: DataFrame, hmap: DataFrame) -> DataFrame:
    """The adjoint of the increments: cells to clusters, then model steps to optimisation steps."""
    keys = ["tracer", "category"]
    cells = adjoint.select(*keys, F.col("itim").alias("itim_mod"), "icell", F.col("flux").alias("value"))
    there = over_space_adjoint(cells, hmap, [*keys, "itim_mod"]).select(*keys, "ipos", "itim_mod", F.col("state").alias("value"))
    return over_time_adjoint(there, tmap, [*keys, "ipos"])
