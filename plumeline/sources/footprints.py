"""Footprint tables of three layouts, each read as rows (obsid, itim, ilat, ilon, sensi) on a model's grid and steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions.checks import checked
from plumeline.operators import footprints
from plumeline.operators.grid import Grid
from plumeline.sources.shared import dealt


@dataclass(frozen=True)
class Footprints:
    """A table, its own grid, step (seconds) and origin, and by how many steps it is moved to a model's."""

    table: DataFrame
    grid: Grid
    step: int
    origin: datetime | None = None
    shift: int = 0
    longest: int | None = None

    def align(self, grid: Grid, step: int, origin: datetime) -> Footprints:
        """On a model's axes; the grid and the step must be the same, and the origins whole steps apart."""
        if grid != self.grid:
            raise ValueError(f"footprints are on {self.grid}, not on {grid}")
        if step != self.step:
            raise ValueError(f"footprints have steps of {self.step} s, not {step} s")
        return replace(self, shift=whole_steps(self.origin, origin, step))

    def rows(self) -> DataFrame:
        """Sensitivities per mol, a last step at the release's end folded into the one before, steps moved to the model's, and at most `longest` before the last."""
        rows = dealt(self.table, "obsid")
        rows = footprints.unit_fixed(rows) if "units" in rows.columns else rows
        if "release_end" in rows.columns:
            at = F.unix_micros(F.lit(str(self.origin)).cast("timestamp")) + F.col("itim").cast("long") * (self.step * 1_000_000)
            rows = footprints.release_folded(rows.withColumn("at_release_end", at == F.unix_micros(F.col("release_end").cast("timestamp"))))
        longest = (1 << 30) if self.longest is None else self.longest
        return footprints.trimmed(rows.select("obsid", "itim", "ilat", "ilon", "sensi"), longest, self.shift)


@dataclass(frozen=True)
class CompressedFootprints(Footprints):
    """Rows (obsid, time, arrays lon, lat, val and indptr): corners of cells, and steps back from the observation's time."""

    model: Grid | None = None
    start: datetime | None = None

    def align(self, grid: Grid, step: int, origin: datetime) -> CompressedFootprints:
        if step != self.step:
            raise ValueError(f"footprints have steps of {self.step} s, not {step} s")
        return replace(self, model=grid, start=origin)

    def rows(self) -> DataFrame:
        g = self.model
        steps = (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lit(str(self.start)).cast("timestamp"))) / (self.step * 1_000_000)
        table = checked(self.table, steps == F.floor(steps), "observations aren't whole steps after the model's start")
        cells = footprints.compressed_to_rows(table).withColumns({"lon": F.col("lon") + self.grid.dlon / 2, "lat": F.col("lat") + self.grid.dlat / 2})
        inside = footprints.clipped(cells, g.lat0, g.lat1, g.lon0, g.lon1)
        moved = inside.join(self.table.select("obsid", F.floor(steps).cast("int").alias("shift")), "obsid")
        return moved.select("obsid", (F.col("itim") + F.col("shift")).alias("itim"), footprints.index_of(F.col("lat"), g.lat0, g.dlat).alias("ilat"), footprints.index_of(F.col("lon"), g.lon0, g.dlon).alias("ilon"), "sensi")


@dataclass(frozen=True)
class DenseFootprints(Footprints):
    """Rows (obsid, itim, ilat, values over longitude)."""

    def rows(self) -> DataFrame:
        return Footprints(footprints.dense_to_rows(self.table), self.grid, self.step, self.origin, self.shift, self.longest).rows()


def whole_steps(own: datetime, model: datetime, step: int) -> int:
    n, rest = divmod((own - model).total_seconds(), step)
    if rest:
        raise ValueError(f"{own} and {model} aren't whole steps of {step} s apart")
    return int(n)


#: Readers of footprints by name: functions of (spark, path, grid, step, origin).
READERS: dict[str, Callable[[SparkSession, str, Grid, int, datetime | None], Footprints]] = {
    "parquet": lambda spark, path, grid, step, origin: Footprints(spark.read.parquet(path), grid, step, origin),
    "compressed": lambda spark, path, grid, step, origin: CompressedFootprints(spark.read.parquet(path), grid, step, origin),
    "dense": lambda spark, path, grid, step, origin: DenseFootprints(spark.read.parquet(path), grid, step, origin),
}


def reader(name: str) -> Callable[[SparkSession, str, Grid, int, datetime | None], Footprints]:
    if name not in READERS:
        raise ValueError(f"unknown footprints: {name}")
    return READERS[name]


def finished(files: DataFrame) -> DataFrame:
    """Of each folder the file that its run finished: rows (folder, file, modified, header, done) with the times of the run's start and end; one file alone is taken as it is."""
    good = (F.col("modified") > F.col("header")) & (F.col("modified") <= F.col("done"))
    counts = files.groupBy("folder").agg(F.count(F.lit(1)).alias("_n"), F.count_if(good).alias("_good"))
    known = checked(counts, (F.col("_n") == 1) | (F.col("_good") == 1), F.concat(F.col("folder"), F.lit(" has not exactly one file between its run's start and end")))
    return files.join(known, "folder").filter((F.col("_n") == 1) | good).drop("_n", "_good")
