"""Points in polygons: a join of points and edges by bands of latitude, and the even-odd rule as a sum.

Polygons are rows of vertices (polygon, ring, seq, lon, lat): rings are closed by themselves,
seq counts without gaps, and rings within rings are holes. Longitudes aren't turned: a polygon
beyond the date line must be given in the points' range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(vertices: DataFrame) -> DataFrame:
    """polygon, x1, y1, x2, y2 of each ring's edges that aren't level: from each vertex to the next, and from the last to the first."""
    ring = ["polygon", "ring"]
    at = F.struct("lon", "lat")
    first = vertices.groupBy(*ring).agg(F.min_by(at, "seq").alias("first"))
    following = vertices.select(*ring, (F.col("seq") - 1).alias("seq"), at.alias("to"))
    rows = vertices.join(following, [*ring, "seq"], "left").join(first, ring).withColumn("to", F.coalesce("to", "first"))
    out = rows.select("polygon", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("to.lon").alias("x2"), F.col("to.lat").alias("y2"))
    return out.filter("y1 <> y2")


def inside(points: DataFrame, vertices: DataFrame, height: float = 1.0) -> DataFrame:
    """The points (point, lon, lat) that lie in a polygon, with it. Bands are `height` degrees; an edge is in all bands that it passes.

    A point is inside if an odd number of edges crosses its latitude to its east. Lower ends of
    edges count, upper ones don't, so a vertex is met once; of a polygon's own edge, the western and southern ones are inside.
    """
    band = lambda y: F.floor(y / height)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges(vertices).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    met = points.select("point", "lon", "lat", band(F.col("lat")).alias("band")).join(spread, "band")
    y = F.col("lat")
    crosses = ((F.col("y1") <= y) & (y < F.col("y2"))) | ((F.col("y2") <= y) & (y < F.col("y1")))
    east = F.col("lon") < F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    odd: Column = F.count(F.lit(1)) % 2 == 1
    return met.filter(crosses & east).groupBy("point", "polygon").agg(odd.alias("odd")).filter("odd").select("point", "polygon")


def land_fractions(cells: DataFrame, vertices: DataFrame, refine: int = 1, height: float = 1.0) -> DataFrame:
    """icell and land_fraction of cells (icell, lat_s, lat_n, lon_w, lon_e): the share of area of those among refine x refine parts whose middle lies in a polygon."""
    if refine != int(refine) or refine < 1:
        raise ValueError("the refinement must be a whole number")
    parts = F.sequence(F.lit(0), F.lit(refine - 1))
    split = cells.select("icell", "lat_s", "lat_n", "lon_w", "lon_e", F.explode(parts).alias("j")).select("*", F.explode(parts).alias("i"))
    south = F.col("lat_s") + (F.col("lat_n") - F.col("lat_s")) * F.col("j") / refine
    north = F.col("lat_s") + (F.col("lat_n") - F.col("lat_s")) * (F.col("j") + 1) / refine
    lon = F.col("lon_w") + (F.col("lon_e") - F.col("lon_w")) * (F.col("i") + 0.5) / refine
    points = split.select(F.struct("icell", "j", "i").alias("point"), ((south + north) / 2).alias("lat"), lon.alias("lon"), (F.sin(F.radians(north)) - F.sin(F.radians(south))).alias("area"))
    land = inside(points, vertices, height).select("point").distinct().withColumn("land", F.lit(1.0))
    share = F.sum(F.col("area") * F.coalesce("land", F.lit(0.0))) / F.sum("area")
    return points.join(land, "point", "left").groupBy(F.col("point.icell").alias("icell")).agg(share.alias("land_fraction"))
