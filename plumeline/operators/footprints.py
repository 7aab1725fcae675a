"""Footprint rows: units, index arithmetic, release times, trimming, dense and compressed input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: sensitivities in s m3 kg-1 to those per mol.
S_M3_KG = 0.0002897


def unit_fixed(footprints: DataFrame, units: str = "units") -> DataFrame:
    return footprints.withColumn("sensi", F.when(F.col(units) == "s m3 kg-1", F.col("sensi") * S_M3_KG).otherwise(F.col("sensi")))


def release_folded(footprints: DataFrame, at_end: str = "at_release_end") -> DataFrame:
    """The last step of a footprint whose release ends with it belongs to the step before; sensitivities are added up anew."""
    last = F.max("itim").over(Window.partitionBy("obsid"))
    moved = footprints.withColumn("_last", last).withColumn("itim", F.when(F.col(at_end) & (F.col("itim") == F.col("_last")), F.col("itim") - 1).otherwise(F.col("itim")))
    return moved.groupBy("obsid", "itim", "ilat", "ilon").agg(F.sum("sensi").alias("sensi"))


def trimmed(footprints: DataFrame, longest: int, shift: Column | int = 0) -> DataFrame:
    """Steps at most `longest` before a footprint's last; footprints that begin before the first step (after the shift) go whole."""
    own = Window.partitionBy("obsid")
    shift = F.lit(shift) if isinstance(shift, int) else shift
    rows = footprints.withColumn("itim", F.col("itim") + shift).withColumns({"_last": F.max("itim").over(own)})
    rows = rows.filter(F.col("_last") - F.col("itim") <= longest).withColumn("_first", F.min("itim").over(own))
    return rows.filter("_first >= 0").drop("_last", "_first")


def clipped(rows: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float) -> DataFrame:
    """Cells whose centres are in the domain."""
    return rows.filter(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1))


def index_of(value: Column, origin: float, size: float) -> Column:
    return F.floor((value - F.lit(origin)) / F.lit(size)).cast("int")


def dense_to_rows(dense: DataFrame, values: str = "values") -> DataFrame:
    """Rows of arrays over longitude to rows of single cells without zeros."""
    rows = dense.select(*[c for c in dense.columns if c != values], F.posexplode(values).alias("ilon", "sensi"))
    return rows.filter("sensi <> 0")


def compressed_to_rows(footprints: DataFrame) -> DataFrame:
    """obsid, and arrays lon, lat, val, indptr (where each step's values begin) to rows; steps count backwards from 0."""
    steps = footprints.select("obsid", "lon", "lat", "val", "indptr", F.posexplode(F.slice("indptr", 1, F.size("indptr") - 1)).alias("step", "first"))
    steps = steps.withColumn("n", F.element_at("indptr", F.col("step") + 2) - F.col("first")).filter("n > 0")
    own = lambda c: F.slice(c, F.col("first") + 1, F.col("n"))
    rows = steps.select("obsid", (-F.col("step")).alias("itim"), F.explode(F.arrays_zip(own("lon").alias("lon"), own("lat").alias("lat"), own("val").alias("sensi"))).alias("c"))
    return rows.select("obsid", "itim", "c.lon", "c.lat", "c.sensi")


def misaligned(footprints: DataFrame, n_times: int, n_lat: int, n_lon: int) -> DataFrame:
    """One row: how many footprint rows lie outside the model's axes."""
    outside = ~(F.col("itim").between(0, n_times - 1) & F.col("ilat").between(0, n_lat - 1) & F.col("ilon").between(0, n_lon - 1))
    return footprints.agg(F.count("*").alias("n"), F.count_if(outside).alias("n_outside"))


def catalog(parts: list[DataFrame]) -> DataFrame:
    """Which file has which footprint (obsid, footprint); the first by name where several have it."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("obsid").agg(F.min("footprint").alias("footprint"))
