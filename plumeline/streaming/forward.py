"""The forward operator over observations as they arrive: a stream joined with static footprints and fluxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.operators.transport import CELL


def modelled(stream: DataFrame, footprints: DataFrame, flux: DataFrame, late: str = "1 day") -> DataFrame:
    """Contributions summed for each observation (obsid, time, tracer) of a stream, late ones too: the join keeps no state.

    The watermark of `late` on time is for aggregates that follow; those leave later rows out. Footprints bring their tracer,
    or meet the fluxes of all tracers, categories added up; what a footprint gives is static, and summed before the stream meets it.
    """
    keys = ["tracer", *CELL] if "tracer" in footprints.columns else CELL
    cells = flux.groupBy("tracer", *CELL).agg(F.sum("flux").alias("flux"))
    static = footprints.select("obsid", *keys, "sensi").join(cells, keys).groupBy("obsid", "tracer").agg(F.sum(F.col("flux") * F.col("sensi")).alias("mix"))
    return stream.withWatermark("time", late).select("obsid", "time", "tracer").join(static, ["obsid", "tracer"])


def hourly_means(modelled: DataFrame, window: str = "1 hour") -> DataFrame:
    """Mean of modelled values by tracer and window, for a stream with a watermark on time."""
    return modelled.groupBy(F.window("time", window), "tracer").agg(F.avg("mix").alias("mix"), F.count("*").alias("n"))
