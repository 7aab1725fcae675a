"""Pre-processed fluxes as a table partitioned by tracer, year and month, whose files are sorted by category.

A category is archived month by month, year by year (month 0), or once for all times
(year 0, month 0). A reader gives each step of a time axis the rows of its month, else
of its year, else the static ones. The choice is a join of the axis with the partitions
that exist, and the archive is joined with the choice by its partition columns, so that
partitions no step asks for aren't scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "t0 timestamp, ilat int, ilon int, flux double, category string, tracer string, year int, month int"
PARTS = ["tracer", "year", "month"]
KEYS = ["category", *PARTS]


def write(flux: DataFrame, times: DataFrame, path: str, by: str = "month") -> None:
    """Adds rows (tracer, category, itim, ilat, ilon, flux) to an archive, at the beginnings t0 of their steps; partitions that get rows are replaced.

    So the categories that are archived alike (by: `month`, `year` or `static`, whose rows have no time) are written together.
    """
    t0 = F.col("t0").cast("timestamp")
    year, month = {"month": (F.year(t0), F.month(t0)), "year": (F.year(t0), F.lit(0)), "static": (F.lit(0), F.lit(0))}[by]
    steps = times.select("itim", t0.alias("t0"), year.alias("year"), month.alias("month"))
    timed = flux.join(steps, "itim")
    if by == "static":
        timed = timed.withColumn("t0", F.lit(None).cast("timestamp"))
    rows = timed.select(*(F.col(name).cast(kind) for name, kind in map(str.split, SCHEMA.split(", "))))
    rows.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, "category").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def candidates(times: DataFrame) -> DataFrame:
    """For each step (itim, t0) the partitions that may have its fluxes, best first by rank."""
    steps = times.select("itim", F.col("t0").cast("timestamp").alias("t0"))
    ranked = steps.select("itim", "t0", F.explode(F.array(
        F.struct(F.year("t0").alias("year"), F.month("t0").alias("month"), F.lit(1).alias("rank")),
        F.struct(F.year("t0").alias("year"), F.lit(0).alias("month"), F.lit(2).alias("rank")),
        F.struct(F.lit(0).alias("year"), F.lit(0).alias("month"), F.lit(3).alias("rank")),
    )).alias("c")).select("itim", "t0", "c.*")
    # true of all: scans are only pruned by joins with tables that have a condition
    return ranked.filter(F.col("rank") <= 3)


def pruned(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The partitions (year, month) that are wanted; of the others nothing is read."""
    months = F.broadcast(wanted.select("year", "month").distinct())  # at most two rows for each month of the axis, and one
    return table.join(months, ["year", "month"], "left_semi")


def choice(table: DataFrame, times: DataFrame) -> DataFrame:
    """For each step (itim, t0) and each category the partition to read: of the month, else of the year, else the static one."""
    wanted = candidates(times)
    found = wanted.join(pruned(table, wanted).select(*KEYS).distinct(), ["year", "month"])
    best = found.groupBy("tracer", "category", "itim").agg(F.min_by(F.struct("t0", "year", "month"), "rank").alias("c"))
    return best.select("tracer", "category", "itim", F.col("c.t0").alias("at"), "c.year", "c.month")


def read(spark: SparkSession, path: str, times: DataFrame) -> DataFrame:
    """Fluxes (tracer, category, itim, ilat, ilon, flux) of the steps of an axis (itim, t0)."""
    table = rows(spark, path)
    chosen = choice(table, times)
    met = pruned(table, candidates(times)).join(chosen, KEYS).filter(F.col("t0").isNull() | (F.col("t0") == F.col("at")))
    return met.select("tracer", "category", "itim", "ilat", "ilon", "flux")


def missing(spark: SparkSession, path: str, times: DataFrame) -> DataFrame:
    """Steps and categories (tracer, category, itim) for which the archive has neither month, year nor static fluxes."""
    table = rows(spark, path)
    every = table.select("tracer", "category").distinct().crossJoin(times.select("itim"))
    return every.join(choice(table, times), ["tracer", "category", "itim"], "left_anti")
