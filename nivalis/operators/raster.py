"""Slope, aspect, roughness and position index of rasters kept as rows (tile, row, col, z).

A cell's neighbours are those whose row or column is next to its own, so that cells that are missing are holes: what needs one
is NULL, as where z itself is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gradients(dem: DataFrame, cell_m: float = 30.0) -> DataFrame:
    """`dem` with slope and aspect in degrees: central differences inside, one-sided at the tile's edges."""
    size = dem.groupBy("tile").agg(*[f(a).alias(f"_{a}_{n}") for a in ("row", "col") for n, f in (("first", F.min), ("last", F.max))])

    def change(along: str, across: str) -> Column:
        w = W.partitionBy("tile", across).orderBy(along)
        ahead, back = F.max("z").over(w.rangeBetween(1, 1)), F.max("z").over(w.rangeBetween(-1, -1))
        z, at = F.col("z"), F.col(along)
        return F.when(at == F.col(f"_{along}_first"), ahead - z).when(at == F.col(f"_{along}_last"), z - back).otherwise((ahead - back) / 2) / cell_m

    out = dem.join(size, "tile").withColumn("_dx", F.when(F.col("z").isNotNull(), change("col", "row"))).withColumn("_dy", F.when(F.col("z").isNotNull(), change("row", "col")))
    slope = F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))))
    return out.select(*dem.columns, slope.alias("slope"), F.pmod(F.degrees(F.atan2(-F.col("_dx"), F.col("_dy"))), F.lit(360.0)).alias("aspect"))


def _reflections(at: Column, first: Column, last: Column, radius: int) -> Column:
    """All places, from `radius` before `first` to as many after `last`, where a border's mirror shows `at`."""
    x, n = at - first, last - first + 1
    turns = F.ceil(radius / (2 * n)).cast("int") + 1
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(2 * n * k + x, 2 * n * k - x - 1)))
    return F.transform(F.filter(places, lambda p: (p >= -radius) & (p < n + radius)), lambda p: p + first)


def mirrored(dem: DataFrame, radius: int) -> DataFrame:
    """`dem` with its borders reflected outward by `radius` cells (the edge cell itself is repeated), again and again where the tile
    is smaller than that."""
    size = dem.groupBy("tile").agg(*[f(a).alias(f"_{a}_{n}") for a in ("row", "col") for n, f in (("first", F.min), ("last", F.max))])
    out = dem.join(size, "tile")
    for axis in ("row", "col"):
        out = out.withColumn(axis, F.explode(_reflections(F.col(axis), F.col(f"_{axis}_first"), F.col(f"_{axis}_last"), radius)))
    return out.drop(*[f"_{a}_{n}" for a in ("row", "col") for n in ("first", "last")])


def box_mean(dem: DataFrame, radius: int, value: str = "z", name: str = "mean") -> DataFrame:
    """`dem` with the mean over the square of 2 radius + 1 cells around each, NULL if one of them is missing: first along columns, then
    along rows."""
    across = W.partitionBy("tile", "row").orderBy("col").rangeBetween(-radius, radius)
    down = W.partitionBy("tile", "col").orderBy("row").rangeBetween(-radius, radius)
    out = dem.withColumn("_s", F.sum(value).over(across)).withColumn("_n", F.count(value).over(across))
    n = (2 * radius + 1) ** 2
    return out.withColumn(name, F.when(F.sum("_n").over(down) == n, F.sum("_s").over(down) / n)).drop("_s", "_n")


def roughness(dem: DataFrame, radius: int = 1) -> DataFrame:
    """Mean distance from the mean of the square around (W14), borders reflected."""
    keep = dem.select("tile", "row", "col")
    pad = box_mean(mirrored(dem, 2 * radius), radius).withColumn("_d", F.abs(F.col("z") - F.col("mean")))
    return keep.join(box_mean(pad, radius, "_d", "roughness").select("tile", "row", "col", "z", "roughness"), ["tile", "row", "col"])


def tpi(dem: DataFrame, radius: int = 10) -> DataFrame:
    """Height above the mean of the square around (W15), borders reflected."""
    keep = dem.select("tile", "row", "col")
    out = box_mean(mirrored(dem, radius), radius).withColumn("tpi", F.col("z") - F.col("mean"))
    return keep.join(out.select("tile", "row", "col", "z", "tpi"), ["tile", "row", "col"])


def elevation_at(points: DataFrame, dem: DataFrame) -> DataFrame:
    """(point_id, z) of points (point_id, tile, y, x), in rows and columns from the tile's corner, with fractions (J2): interpolated in the
    square of the point's cell and the next ones to the right and below. Beyond the tile's last row or column the point's own
    cell counts; with a hole in the square, or outside the tile, z is NULL. Point ids must be unique."""
    size = dem.groupBy("tile").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    at = points.join(size, "tile").select("point_id", "tile", F.floor("y").alias("r"), F.floor("x").alias("c"), (F.col("y") - F.floor("y")).alias("v"), (F.col("x") - F.floor("x")).alias("h"), "_rows", "_cols")
    right, below = F.col("c") < F.col("_cols"), F.col("r") < F.col("_rows")
    cell = lambda ok, down, across, w: F.struct((F.col("r") + F.when(ok, down).otherwise(0)).alias("row"), (F.col("c") + F.when(ok, across).otherwise(0)).alias("col"), w.alias("w"))
    v, h = F.col("v"), F.col("h")
    square = F.array(cell(F.lit(True), 0, 0, (1 - v) * (1 - h)), cell(right, 0, 1, (1 - v) * h), cell(below, 1, 0, v * (1 - h)), cell(right & below, 1, 1, v * h))
    corners = at.select("point_id", "tile", F.explode(square).alias("s")).select("point_id", "tile", "s.*")
    got = corners.join(dem.select("tile", "row", "col", "z"), ["tile", "row", "col"]).groupBy("point_id").agg(F.when(F.count("z") == 4, F.sum(F.col("z") * F.col("w"))).alias("z"))
    return points.select("point_id").join(got, "point_id", "left")


def tile_catalogue(dem: DataFrame, crs: str = "EPSG:4326") -> DataFrame:
    """(tile, rows, cols, cells, z_min, z_max), and where cells have lat and lon also (west, south, east, north, crs)."""
    size = [(F.max("row") - F.min("row") + 1).alias("rows"), (F.max("col") - F.min("col") + 1).alias("cols"), F.count("*").alias("cells"), F.min("z").alias("z_min"), F.max("z").alias("z_max")]
    bounds = [F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.lit(crs).alias("crs")]
    return dem.groupBy("tile").agg(*size, *(bounds if {"lat", "lon"} <= set(dem.columns) else []))


def tiles_of_boxes(boxes: DataFrame) -> DataFrame:
    """One row for each 1-degree tile that a box (box_id, west, south, east, north) meets, with its name."""
    out = boxes.select("box_id", F.explode(F.sequence(F.floor("south"), F.floor("north"))).alias("lat"), F.floor("west").alias("w"), F.floor("east").alias("e")).select("box_id", "lat", F.explode(F.sequence("w", "e")).alias("lon"))
    two = lambda c, pos, neg, n: F.concat(F.when(F.col(c) >= 0, pos).otherwise(neg), F.lpad(F.abs(c).cast("string"), n, "0"))
    return out.withColumn("tile", F.concat(F.lit("Copernicus_DSM_COG_10_"), two("lat", "N", "S", 2), F.lit("_00_"), two("lon", "E", "W", 3), F.lit("_00_DEM")))
