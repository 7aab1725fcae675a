"""Writes an archive of pre-processed fluxes, by tracer, year and month, and their budgets.

Inventories are tables of amounts by cell and step in a folder (with cells and steps). A run
takes the steps of a period, brings amounts to fluxes per area and second, adds combined
categories, and writes each month as a partition of its own: `<output>/fluxes` by tracer,
year and month, which readers of plumeline.sources.archive prune, and
`<output>/budgets`, the amounts of each tracer and category by year and month.

Months of the period are replaced, others stay (dynamic partition overwrite), so a run can be
repeated, after a break too, and a long period can be done a year at a time. The period is
half-open and counts months; without one, all steps are taken. Negative fluxes and fluxes
of nothing are kept; a null amount counts as nothing.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import given
from plumeline.functions.expressions import terms_table
from plumeline.operators import flux as fluxes
from plumeline.sources import archive, shared
from plumeline.sources.fixtures import view

log = logging.getLogger("plumeline.jobs.flux_archive")

BUDGETS = "tracer string, category string, amount double, year int, month int"


def within(times: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The steps (itim, t0, dt) that begin in a half-open period of months such as 1995-01."""
    if start:
        times = times.filter(F.col("t0") >= F.lit(f"{start}-01").cast("date"))
    return times.filter(F.col("t0") < F.lit(f"{end}-01").cast("date")) if end else times


def monthly_budgets(amounts: DataFrame, times: DataFrame) -> DataFrame:
    steps = amounts.groupBy("tracer", "category", "itim").agg(F.sum("flux").alias("part"))
    named = steps.join(times.select("itim", F.year("t0").alias("year"), F.month("t0").alias("month")), "itim")
    return named.groupBy("tracer", "category", "year", "month").agg(F.sum("part").alias("amount"))


def run(spark: SparkSession, source: str, output: str, start: str | None = None, end: str | None = None, combined: dict[str, str] | None = None) -> dict:
    """Archives the fluxes of a period, and gives the numbers of rows read and written."""
    times = within(view(spark, source, "fx_time"), start, end)
    amounts = fluxes.without_null(view(spark, source, "fx_flux").join(times.select("itim"), "itim", "left_semi"))
    if combined:
        amounts = fluxes.resolved(amounts, terms_table(spark, combined))
    cells = view(spark, source, "fx_cell")
    archive.write(fluxes.to_intensive(amounts, cells, times), times, f"{output}/fluxes")
    monthly_budgets(amounts, times).hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(f"{output}/budgets")
    counts = {"read": amounts.count(), "archived": archive.rows(spark, f"{output}/fluxes").count(), "budgets": shared.read_or_empty(spark, f"{output}/budgets", BUDGETS).count()}
    log.info("read %d amounts of %s from %s to %s", counts["read"], source, start or "the first step", end or "the last")
    log.info("%s/fluxes has %d fluxes, %s/budgets %d amounts", output, counts["archived"], output, counts["budgets"])
    return counts


def archived(spark: SparkSession, output: str) -> DataFrame:
    """All fluxes of the archive beside the amount of their month."""
    budgets = shared.read_or_empty(spark, f"{output}/budgets", BUDGETS)
    return archive.rows(spark, f"{output}/fluxes").join(budgets, ["tracer", "category", "year", "month"])


def main(args: list[str] | None = None) -> int:
    settings = given(__doc__, os.path.join(os.path.dirname(os.path.abspath(__file__)), "flux_archive.json"), args)
    spark = SparkSession.builder.appName("flux_archive").getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
