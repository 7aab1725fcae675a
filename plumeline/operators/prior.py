"""Prior uncertainty: distances, correlation kernels, total errors, and the square root of the covariance."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.functions.timeaxis import step

#: Fixed value: kilometres, for distances.
EARTH_KM = 6371.0
#: Parts of a join of neighbours for each shuffle partition, and positions of a cell in a block.
PARTS, BLOCK = 16, 4096

KERNELS: dict[str, Callable[[Column, float], Column]] = {
    "g": lambda d, length: F.exp(-(d / length) * (d / length)),
    "e": lambda d, length: F.exp(-d / length),
    "h": lambda d, length: F.lit(1.0) / (F.lit(1.0) + d / length),
}
ARRAY_KERNELS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "g": lambda d, length: np.exp(-((d / length) ** 2)),
    "e": lambda d, length: np.exp(-d / length),
    "h": lambda d, length: 1 / (1 + d / length),
}


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, stretch: float = 1.0, cosines: Column | None = None) -> Column:
    """Kilometres between two points; longitudes may count for more or less. The product of their latitudes' cosines may be known."""
    cosines = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) if cosines is None else cosines
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) * stretch / 2)
    inner = half_lat * half_lat + cosines * half_lon * half_lon
    inner = F.least(inner, F.lit(1.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(inner), F.sqrt(1 - inner))  # as asin(sqrt(inner)), whose JVM function takes five times as long


def distances(points: DataFrame, stretch: float = 1.0) -> DataFrame:
    """i, j, distance of all pairs i <= j of the state's positions (ipos, lat, lon).

    A correlation matrix is quadratic by nature; positions number some thousands, and one side goes to all tasks.
    """
    a = points.select(F.col("ipos").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = F.broadcast(points.select(F.col("ipos").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
    return a.join(b, F.col("i") <= F.col("j")).select("i", "j", great_circle(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), stretch).alias("distance"))


def mirrored(upper: DataFrame, value: str) -> DataFrame:
    """The whole of a symmetric matrix from its upper triangle."""
    return upper.unionByName(upper.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def kernel_and_length(text: str) -> tuple[float, str]:
    """`500-e`: length and kernel."""
    got = re.fullmatch(r"([0-9.]+)-([a-z]+)", text)
    if not got or got[2] not in KERNELS:
        raise ValueError(f"unknown correlation: {text}")
    return float(got[1]), got[2]


def temporal_length(length: str, interval: str) -> float:
    """A correlation time as a number of optimisation intervals; both fixed durations or both calendar steps."""
    return step(length).ratio(step(interval))


def spatial_correlations(distances: DataFrame, kind: str, length: float, least: float = 1e-7) -> DataFrame:
    """i, j, corr of distances; correlations below the least are dropped."""
    if kind not in KERNELS:
        raise ValueError(f"unknown kernel: {kind}")
    return distances.select("i", "j", KERNELS[kind](F.col("distance"), length).alias("corr")).filter(F.abs("corr") >= least)


def reach(kind: str, length: float, least: float) -> float:
    """Kilometres beyond which a correlation is below the least."""
    return {"g": length * math.sqrt(-math.log(least)), "e": -length * math.log(least), "h": length * (1 / least - 1)}[kind]


def with_vector(points: DataFrame, side: str) -> DataFrame:
    """Positions with x, y and z on a sphere of radius 1, and the cosine of the latitude."""
    lat, lon = F.radians(f"lat{side}"), F.radians(f"lon{side}")
    return points.withColumns({f"cos{side}": F.cos(lat), f"x{side}": F.cos(lat) * F.cos(lon), f"y{side}": F.cos(lat) * F.sin(lon), f"z{side}": F.sin(lat)})


def dense_cells(cells: DataFrame, parts: int) -> DataFrame:
    """cell, slices, blocks: cells of positions that have more than a part's share of all pairs or fill more than a block, into how many slices of those that look and blocks of those that are seen they go."""
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
    share = F.col("n") * F.col("n") * parts / counts.agg(F.sum(F.col("n") * F.col("n"))).scalar()
    return counts.select("cell", F.ceil(F.least("n", share)).cast("int").alias("slices"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).filter("slices > 1 or blocks > 1")


def neighbours(points: DataFrame, far: float, stretch: float = 1.0, near: Callable[[Column], Column] | None = None) -> DataFrame:
    """i, j, distance of the pairs i <= j of positions (ipos, lat, lon) that are at most `far` kilometres apart; ipos is a key.

    The space around the sphere is cut into cubes no narrower than `far`. Each position is in
    one and looks into those around it that come after its own and are near enough, so only
    neighbours meet, once, in an equi-join on cubes. Where longitudes are stretched, far
    apart ones may be near again, and bands of latitude are cut instead.
    `near` tells of a distance that is `far`, give or take a part in 10**9, whether it is meant.
    """
    near = near or (lambda d: d <= far)
    angle = far / EARTH_KM
    chord = 2 * math.sin(min(angle, math.pi) / 2)
    sphere = stretch == 1.0
    every = angle >= math.pi * (1 + 1e-8)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = points.select("ipos", F.col("lat").cast("double"), F.col("lon").cast("double")).filter("ipos is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").repartition(parts, "ipos")
    width = max(chord * (1 + 1e-6) + 1e-9, 1e-6) if sphere else max(math.degrees(angle) * (1 + 1e-6), 1e-4)
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = [(a + 1) / width for a in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))] if sphere else [(F.col("lat") + 90) / width]
    names = [f"axis{k}" for k in range(len(axes))]
    # a cube's number has 21 bits for each axis, and the ones beside it are at set distances
    bits = [21 * k for k in range(len(axes))]
    cell = sum((F.shiftleft(F.floor(n), b) for n, b in zip(names, bits, strict=True)), F.lit(0).cast("long"))
    placed = known.withColumns(dict(zip(names, axes, strict=True))).withColumn("cell", cell)
    # ways to look, with the cube's own first; a case for each way would make too long a method for the JVM to compile
    ways = [w for w in product((-1, 0, 1), repeat=len(axes)) if w >= (0,) * len(axes)]
    every_way = F.array(*(F.struct(F.lit(sum(k << b for k, b in zip(w, bits, strict=True))).cast("long").alias("by"), *(F.lit(k).alias(n) for k, n in zip(w, names, strict=True))) for w in ways))
    way = {n: F.col(f"way.{n}") for n in names}
    squares = lambda xs: sum((x * x for x in xs), F.lit(0.0))
    # how far the cube beside begins: before this place if it is the one before
    worth = squares(F.when(way[n] == 0, 0.0).otherwise(F.col(f"in_{n}") - F.greatest(way[n], F.lit(0))) for n in names) <= 1 + 1e-6
    if sphere:  # cubes that the sphere doesn't pass through are empty: their middles are more than half a diagonal away
        reaches = 0.8661 * width
        worth &= squares(F.col(f"mid_{n}") + way[n] * width for n in names).between(max(0.0, 1 - reaches) ** 2, (1 + reaches) ** 2)
    # pairs are many more than positions: more parts than a shuffle of positions has, and slices of dense cells, deal them out
    dense = F.broadcast(dense_cells(placed.select("cell"), PARTS * parts))
    slices, blocks = (F.coalesce(c, F.lit(1)) for c in ("slices", "blocks"))
    key = ["cell", "slice"]
    own = placed.select("cell", F.col("ipos").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).join(dense, "cell", "left")
    own = own.withColumns({"block": F.pmod(F.hash("j"), blocks), "slice": F.explode(F.sequence(F.lit(0), slices - 1))}).drop("slices", "blocks").repartition(PARTS * parts, *key)
    # a block's positions lie beside each other in one row, as they are gone through again and again
    side = ["j", "lat2", "lon2", "cos2", "x2", "y2", "z2"] if sphere else ["j", "lat2", "lon2", "cos2"]
    own = with_vector(own, "2").groupBy(*key, "block").agg(F.collect_list(F.struct(*side)).alias("seen")).select(*key, "seen")
    inside = placed.select(F.col("ipos").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "cell", *((F.col(n) - F.floor(n)).alias(f"in_{n}") for n in names), *(((F.floor(n) + 0.5) * width - 1).alias(f"mid_{n}") for n in names))
    looks = inside.withColumn("way", F.explode(every_way)).filter(worth).select("i", "lat1", "lon1", (F.col("cell") + F.col("way.by")).alias("cell"), (F.col("way.by") == 0).alias("own"))
    looks = looks.join(dense, "cell", "left").withColumn("slice", F.pmod(F.hash("i"), slices)).drop("slices", "blocks").repartition(PARTS * parts, *key)
    met = with_vector(looks, "1").join(own.hint("merge"), key)
    met = met.select("i", "own", *(f"{c}1" for c in ("lat", "lon", "cos", "x", "y", "z")), F.inline("seen")).filter(~F.col("own") | (F.col("i") <= F.col("j")))
    distance = great_circle(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), stretch, F.col("cos1") * F.col("cos2"))
    if sphere and not every:  # the chord tells most pairs that are near or far; only where it doesn't the distance decides
        square = squares(F.col(f"{a}1") - F.col(f"{a}2") for a in "xyz")
        below, above = max(chord * (1 - 5e-9) - 1e-15, 0.0) ** 2, (chord * (1 + 5e-9) + 1e-15) ** 2
        met = met.filter((square <= above) & ((square < below) | near(distance)))
    elif not every:
        met = met.filter(near(distance))
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), distance.alias("distance"))


def near_correlations(points: DataFrame, kind: str, length: float, least: float = 1e-7, stretch: float = 1.0) -> DataFrame:
    """i, j, corr of all positions, from neighbours alone; correlations below the least are dropped."""
    if kind not in KERNELS:
        raise ValueError(f"unknown kernel: {kind}")
    corr = lambda d: KERNELS[kind](d, length)
    near = neighbours(points, reach(kind, length, least) * (1 + 1e-9), stretch, lambda d: corr(d) >= least)
    return near.select("i", "j", corr(F.col("distance")).alias("corr"))


def temporal_correlations(steps: DataFrame, dt: float, length: float) -> DataFrame:
    """i, j, corr of steps (itime) dt long; each with itself only if the length is nothing."""
    a, b = steps.select(F.col("itime").alias("i")), F.broadcast(steps.select(F.col("itime").alias("j")))
    if length < 1e-20:
        return a.join(b, F.col("i") == F.col("j")).withColumn("corr", F.lit(1.0))
    return a.crossJoin(b).withColumn("corr", F.exp(-F.abs(F.col("i") - F.col("j")) * dt / length))


def total_uncertainty(sigma: DataFrame, temporal: DataFrame, spatial: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of `by`): the error of the sum of all elements of a state (itime, ipos, sigma), whose correlation is a product of one in time and one in space.

    The product matrix is never made: space first, then time, then the sum.
    """
    over_space = sigma.join(spatial, F.col("ipos") == F.col("j")).groupBy(*by, "itime", "i").agg(F.sum(F.col("corr") * F.col("sigma")).alias("s"))
    over_time = over_space.select(*by, F.col("itime").alias("k"), F.col("i").alias("ipos"), "s").join(temporal, F.col("k") == F.col("j")).groupBy(*by, F.col("i").alias("itime"), "ipos").agg(F.sum(F.col("corr") * F.col("s")).alias("s"))
    return over_time.join(sigma, [*by, "itime", "ipos"]).groupBy(*by).agg(F.sqrt(F.sum(F.col("sigma") * F.col("s"))).alias("total"))


def prior_errors(flux: DataFrame) -> DataFrame:
    return flux.withColumn("sigma", F.abs("flux"))


def scaled_errors(sigma: DataFrame, total: DataFrame, target: float, times: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors scaled so that their total (one row, or one for each value of `by`) is a target per year over the period of the steps (itime, dt in seconds)."""
    years = times.select("itime", "dt").distinct().agg((F.sum("dt") / F.lit(365.25 * 86400)).alias("years"))
    factor = total.crossJoin(F.broadcast(years)).select(*by, (F.lit(target) / F.col("total") * F.col("years")).alias("scale"))
    met = sigma.join(factor, list(by)) if by else sigma.crossJoin(F.broadcast(factor))
    return met.withColumn("sigma", F.col("sigma") * F.col("scale"))


# --- the state's own size: arrays on the driver ---


def distance_matrix(lat: np.ndarray, lon: np.ndarray, stretch: float = 1.0) -> np.ndarray:
    """Kilometres between all positions."""
    lat, lon = np.radians(lat), np.radians(lon)
    half_lat, half_lon = (np.sin(np.subtract.outer(x, x) * s / 2) for x, s in ((lat, 1.0), (lon, stretch)))
    inner = half_lat**2 + np.multiply.outer(np.cos(lat), np.cos(lat)) * half_lon**2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(inner, 1.0)))


def digest(matrix: np.ndarray) -> str:
    """Under which a decomposition can be kept."""
    return hashlib.md5(np.ascontiguousarray(matrix, "<f8").tobytes()).hexdigest()  # noqa: S324


def spatial_root(corr: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """L with L @ L.T the correlation; eigenvalues below a share of the greatest (or of 1) are raised to it."""
    values, vectors = np.linalg.eigh(corr)
    return vectors * np.sqrt(np.maximum(values, least * min(1.0, values.max())))


def temporal_root(corr: np.ndarray) -> np.ndarray:
    """L of falling eigenvalues; the first row isn't negative."""
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return vectors * np.where(vectors[0] < 0, -1.0, 1.0) * np.sqrt(np.maximum(values[order], 0))


def cached_root(corr: np.ndarray, spark, folder: str | None, root: Callable[[np.ndarray], np.ndarray] = spatial_root) -> np.ndarray:
    """A root from the table in a folder that is named after the matrix, or made and kept there."""
    if folder is None:
        return root(corr)
    path = f"{folder.rstrip('/')}/{digest(corr)}"
    try:
        rows = spark.read.parquet(path).orderBy("i").collect()
        return np.array([r["row"] for r in rows])
    except Exception as error:  # not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    made = root(corr)
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(made)], "i int, row array<double>").write.mode("ignore").parquet(path)
    return made


def precondition(state: np.ndarray, sigma: np.ndarray, in_time: np.ndarray, in_space: np.ndarray) -> np.ndarray:
    """State (times, positions) from independent variables: sigma * (Lt @ w @ Lh.T)."""
    return sigma * (in_time @ state @ in_space.T)


def precondition_adjoint(gradient: np.ndarray, sigma: np.ndarray, in_time: np.ndarray, in_space: np.ndarray) -> np.ndarray:
    return in_time.T @ (sigma * gradient) @ in_space
