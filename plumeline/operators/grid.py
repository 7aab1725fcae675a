"""Regular grids, overlaps of axes, and conservative regridding."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: metres, for areas.
EARTH_RADIUS = 6378100.0


@dataclass(frozen=True)
class Grid:
    """A regular grid of cells between bounds in degrees."""

    lon0: float
    lon1: float
    lat0: float
    lat1: float
    nlon: int
    nlat: int

    @classmethod
    def of(cls, *, lon0: float | None = None, lon1: float | None = None, dlon: float | None = None, nlon: int | None = None, lat0: float | None = None, lat1: float | None = None, dlat: float | None = None, nlat: int | None = None) -> Grid:
        """A grid from any three of start, end, size and number of cells of each axis."""
        x0, x1, nx = axis_of(lon0, lon1, dlon, nlon)
        y0, y1, ny = axis_of(lat0, lat1, dlat, nlat)
        return cls(x0, x1, y0, y1, nx, ny)

    @property
    def dlon(self) -> float:
        return round((self.lon1 - self.lon0) / self.nlon, 10)

    @property
    def dlat(self) -> float:
        return round((self.lat1 - self.lat0) / self.nlat, 10)

    @property
    def shape(self) -> tuple[int, int]:
        return self.nlat, self.nlon

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return self.lon0, self.lon1, self.lat0, self.lat1

    @property
    def is_cyclic(self) -> bool:
        return math.isclose(self.lon1 - self.lon0, 360.0)

    @property
    def is_global(self) -> bool:
        return self.is_cyclic and math.isclose(self.lat1 - self.lat0, 180.0)

    def __le__(self, other: Grid) -> bool:
        return other.lon0 <= self.lon0 and self.lon1 <= other.lon1 and other.lat0 <= self.lat0 and self.lat1 <= other.lat1

    def __lt__(self, other: Grid) -> bool:
        return self <= other and self.extent != other.extent

    def indices(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor((lat - self.lat0) / self.dlat), math.floor((lon - self.lon0) / self.dlon)

    def expanded(self, west: float = 0.0, east: float = 0.0) -> Grid:
        """Wider by whole cells."""
        a, b = round(west / self.dlon), round(east / self.dlon)
        return Grid(self.lon0 - a * self.dlon, self.lon1 + b * self.dlon, self.lat0, self.lat1, self.nlon + a + b, self.nlat)

    def padded(self, to: Grid) -> Grid:
        """The least grid of the same cells that covers another one too."""
        more = lambda gap, size: max(0, math.ceil(round(gap / size, 6)))
        w, e = more(self.lon0 - to.lon0, self.dlon), more(to.lon1 - self.lon1, self.dlon)
        s, n = more(self.lat0 - to.lat0, self.dlat), more(to.lat1 - self.lat1, self.dlat)
        return Grid(self.lon0 - w * self.dlon, self.lon1 + e * self.dlon, self.lat0 - s * self.dlat, self.lat1 + n * self.dlat, self.nlon + w + e, self.nlat + s + n)

    def axis(self, spark: SparkSession, name: str) -> DataFrame:
        """i, low, high of `lat` or `lon`."""
        n, low, size = (self.nlat, self.lat0, self.dlat) if name == "lat" else (self.nlon, self.lon0, self.dlon)
        edge = lambda k: F.round(F.lit(low) + k * F.lit(size), 5)
        return spark.range(n).select(F.col("id").cast("int").alias("i"), edge(F.col("id")).alias("low"), edge(F.col("id") + 1).alias("high"))

    def cells(self, spark: SparkSession) -> DataFrame:
        """ilat, ilon, icell, bounds, centres and area of each cell."""
        lat = self.axis(spark, "lat").select(F.col("i").alias("ilat"), F.col("low").alias("lat_s"), F.col("high").alias("lat_n"))
        lon = self.axis(spark, "lon").select(F.col("i").alias("ilon"), F.col("low").alias("lon_w"), F.col("high").alias("lon_e"))
        both = lat.crossJoin(F.broadcast(lon))
        return both.withColumns({"icell": F.col("ilat") * self.nlon + F.col("ilon"), "lat": (F.col("lat_s") + F.col("lat_n")) / 2, "lon": (F.col("lon_w") + F.col("lon_e")) / 2, "area": cell_area(F.col("lat_s"), F.col("lat_n"), F.col("lon_w"), F.col("lon_e"))})


def axis_of(start: float | None, end: float | None, size: float | None, n: int | None) -> tuple[float, float, int]:
    if n is None:
        if None in (start, end, size):
            raise ValueError("three of start, end, size and number are needed")
        exact = (end - start) / size
        n = round(exact)
        if not math.isclose(exact, n, abs_tol=1e-6):
            raise ValueError(f"no whole number of cells of {size} between {start} and {end}")
    if start is None:
        start = end - n * size
    if end is None:
        end = start + n * size
    return float(start), float(end), int(n)


def europe(size: float = 0.25) -> Grid:
    return Grid.of(lon0=-15, lon1=35, dlon=size, lat0=33, lat1=73, dlat=size)


def global_steps(dlon: float, dlat: float) -> Grid:
    return Grid.of(lon0=-180, lon1=180, dlon=dlon, lat0=-90, lat1=90, dlat=dlat)


def polar_edges(nlat: int) -> list[float]:
    """Latitude bounds of a global grid of points at both poles, whose outer cells are half as high."""
    size = 180.0 / (nlat - 1)
    return [-90.0, *[-90 + size * (k + 0.5) for k in range(nlat - 1)], 90.0]


def axis_of_edges(spark: SparkSession, edges: list[float]) -> DataFrame:
    """i, low, high of an axis whose cells differ in size."""
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "i int, low double, high double")


def cells_of_axes(lat: DataFrame, lon: DataFrame) -> DataFrame:
    """ilat, ilon, bounds and area of the cells of two axes (i, low, high), whatever their sizes."""
    a = lat.select(F.col("i").alias("ilat"), F.col("low").alias("lat_s"), F.col("high").alias("lat_n"))
    b = lon.select(F.col("i").alias("ilon"), F.col("low").alias("lon_w"), F.col("high").alias("lon_e"))
    return a.crossJoin(F.broadcast(b)).withColumn("area", cell_area(F.col("lat_s"), F.col("lat_n"), F.col("lon_w"), F.col("lon_e")))


def grid_from(settings: dict, name: str, fallback: str = "grid") -> Grid:
    """A grid from flat keys `name.lon0` ..., each with the fallback's value where it is missing."""
    get = lambda k: settings.get(f"{name}.{k}", settings.get(f"{fallback}.{k}"))
    return Grid.of(**{k: get(k) for k in ("lon0", "lon1", "dlon", "nlon", "lat0", "lat1", "dlat", "nlat")})


def cell_area(south: Column, north: Column, west: Column, east: Column) -> Column:
    return F.lit(EARTH_RADIUS * EARTH_RADIUS) * F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))


def overlaps(source: DataFrame, target: DataFrame, kind: str = "linear", cyclic: bool = False) -> DataFrame:
    """i (source), j (target) and frac, the share of the source cell in the target cell, of two axes (i, low, high).

    kind: `linear` in degrees, `sine` by the area between latitudes, `sin_delta` by the sine of the differences. Cyclic axes
    meet at copies of the source 360 degrees away too. An axis has a few thousand cells at most: the target goes to all tasks.
    """
    a = source.select("i", "low", "high")
    if cyclic:
        a = a.withColumn("turn", F.explode(F.array(*[F.lit(x) for x in (-360.0, 0.0, 360.0)]))).select("i", (F.col("low") + F.col("turn")).alias("low"), (F.col("high") + F.col("turn")).alias("high"))
    b = F.broadcast(target.select(F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2")))
    both = a.join(b, (F.col("low") < F.col("high2")) & (F.col("high") > F.col("low2")))
    low, high = F.greatest("low", "low2"), F.least("high", "high2")
    size = {
        "linear": lambda x, y: y - x,
        "sine": lambda x, y: F.sin(F.radians(y)) - F.sin(F.radians(x)),
        "sin_delta": lambda x, y: F.sin(F.radians(y - x)),
    }[kind]
    return both.select("i", "j", (size(low, high) / size(F.col("low"), F.col("high"))).alias("frac"))


def regridded(rows: DataFrame, by_lat: DataFrame, by_lon: DataFrame, keys: list[str], value: str = "flux") -> DataFrame:
    """Amounts of cells dealt to the cells of another grid: along longitudes first, which leaves fewer rows for the latitudes."""
    lon = by_lon.select(F.col("i").alias("ilon"), F.col("j").alias("jlon"), F.col("frac").alias("f_lon"))
    lat = by_lat.select(F.col("i").alias("ilat"), F.col("j").alias("jlat"), F.col("frac").alias("f_lat"))
    first = rows.join(F.broadcast(lon), "ilon").groupBy(*keys, "ilat", "jlon").agg(F.sum(F.col(value) * F.col("f_lon")).alias(value))
    second = first.join(F.broadcast(lat), "ilat").groupBy(*keys, "jlat", "jlon").agg(F.sum(F.col(value) * F.col("f_lat")).alias(value))
    return second.select(*keys, F.col("jlat").alias("ilat"), F.col("jlon").alias("ilon"), value)


def regrid(rows: DataFrame, source: Grid, target: Grid, keys: list[str], value: str = "flux", density: bool = False) -> DataFrame:
    """Conservative regridding of amounts, or of densities by way of amounts."""
    spark = rows.sparkSession
    if density:
        rows = to_quantity(rows, source.cells(spark), value)
    by_lat = overlaps(source.axis(spark, "lat"), target.axis(spark, "lat"), "sine")
    by_lon = overlaps(source.axis(spark, "lon"), target.axis(spark, "lon"), cyclic=source.is_cyclic)
    out = regridded(rows, by_lat, by_lon, keys, value)
    return to_density(out, target.cells(spark), value) if density else out


def transform(rows: DataFrame, source: Grid, target: Grid, keys: list[str], value: str = "flux", padding: float = 0.0, density: bool = False) -> DataFrame:
    """Rows on another grid, also where it goes beyond theirs: cells out there hold the padding; then regridded, which crops."""
    wide = source.padded(target)
    south, west = round((source.lat0 - wide.lat0) / source.dlat), round((source.lon0 - wide.lon0) / source.dlon)
    if wide.shape != source.shape:
        rows = padded(rows, south, wide.nlat - source.nlat - south, west, wide.nlon - source.nlon - west, source.nlat, source.nlon, keys, value, padding)
    return regrid(rows, wide, target, keys, value, density)


def to_quantity(rows: DataFrame, cells: DataFrame, value: str = "flux") -> DataFrame:
    return rows.join(F.broadcast(cells.select("ilat", "ilon", "area")), ["ilat", "ilon"]).withColumn(value, F.col(value) * F.col("area")).drop("area")


def to_density(rows: DataFrame, cells: DataFrame, value: str = "flux") -> DataFrame:
    return rows.join(F.broadcast(cells.select("ilat", "ilon", "area")), ["ilat", "ilon"]).withColumn(value, F.col(value) / F.col("area")).drop("area")


def cropped(rows: DataFrame, cells: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float) -> DataFrame:
    """Rows of cells whose centres lie inside, with indices from the new corner."""
    lat, lon = (F.col("lat_s") + F.col("lat_n")) / 2, (F.col("lon_w") + F.col("lon_e")) / 2
    inside = cells.filter((lat > lat0) & (lat < lat1) & (lon > lon0) & (lon < lon1)).select("ilat", "ilon")
    corner = inside.agg(F.min("ilat").alias("lat_"), F.min("ilon").alias("lon_"))
    moved = rows.join(F.broadcast(inside.crossJoin(F.broadcast(corner))), ["ilat", "ilon"])
    return moved.withColumns({"ilat": F.col("ilat") - F.col("lat_"), "ilon": F.col("ilon") - F.col("lon_")}).drop("lat_", "lon_")


def padded(rows: DataFrame, south: int, north: int, west: int, east: int, nlat: int, nlon: int, keys: list[str], value: str = "flux", padding: float = 0.0) -> DataFrame:
    """Rows on a grid with so many more cells on each side, which hold the padding."""
    spark = rows.sparkSession
    lat = spark.range(nlat + south + north).select(F.col("id").cast("int").alias("ilat"))
    lon = spark.range(nlon + west + east).select(F.col("id").cast("int").alias("ilon"))
    every = rows.select(*keys).distinct().crossJoin(F.broadcast(lat)).crossJoin(F.broadcast(lon))
    moved = rows.withColumns({"ilat": F.col("ilat") + south, "ilon": F.col("ilon") + west})
    return every.join(moved, [*keys, "ilat", "ilon"], "left").withColumn(value, F.coalesce(value, F.lit(padding)))


def land_share(fine: DataFrame, by_lat: DataFrame, by_lon: DataFrame) -> DataFrame:
    """Area means of a fine mask (ilat, ilon, area, mask) in the cells of a coarser grid."""
    weighted = fine.withColumn("ma", F.col("mask") * F.col("area"))
    top = regridded(weighted, by_lat, by_lon, [], "ma")
    bottom = regridded(fine, by_lat, by_lon, [], "area")
    return top.join(bottom, ["ilat", "ilon"]).select("ilat", "ilon", (F.col("ma") / F.col("area")).alias("land_fraction"))
