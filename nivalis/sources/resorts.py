"""Ski areas and lifts from GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.functions.geo import WESTERN_US, in_box
from nivalis.sources.geojson import feature_texts

RINGS = "array<array<array<double>>>"


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(geometry, properties) as JSON text, a row a feature; geometries nest to different depths, so they stay text (S13). A large
    file is read by many tasks."""
    return feature_texts(spark, path).select(F.get_json_object("text", "$.geometry").alias("geometry"), F.get_json_object("text", "$.properties").alias("properties"))


def centroid(ring: Column) -> Column:
    """(lon, lat) of a closed ring by the shoelace formula; of a flat one the mean of its points. One pass over the ring, which is
    evaluated once however dear it is."""
    names = ("n", "px", "py", "area", "ax", "ay", "mx", "my")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names])

    def step(acc, p):
        old = {c: acc[c] for c in names}
        cross = F.when(old["n"] == 0, 0.0).otherwise(old["px"] * p[1] - p[0] * old["py"])
        new = {"n": old["n"] + 1, "px": p[0], "py": p[1], "area": old["area"] + cross, "ax": old["ax"] + (old["px"] + p[0]) * cross, "ay": old["ay"] + (old["py"] + p[1]) * cross, "mx": old["mx"] + p[0], "my": old["my"] + p[1]}
        return F.struct(*[x.alias(c) for c, x in new.items()])

    def place(acc):
        pick = lambda s, m: F.when(F.abs(acc["area"]) > 1e-12, F.try_divide(acc[s], 3 * acc["area"])).otherwise(F.try_divide(acc[m], acc["n"]))
        return F.struct(pick("ax", "mx").alias("lon"), pick("ay", "my").alias("lat"))

    return F.aggregate(ring, zero, step, place)


def ski_areas(features: DataFrame) -> DataFrame:
    """(name, lat, lon, country, state): named areas with a geometry (S13, S14). The country falls back to the first source's.

    A geometry is parsed in a generator, into which no filter or other column is moved, so once a row."""
    get = lambda p: F.get_json_object("properties", p)
    kind = F.get_json_object("geometry", "$.type")
    point = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
    ring = F.when(kind == "Polygon", F.from_json(F.get_json_object("geometry", "$.coordinates"), RINGS)[0]).when(kind == "MultiPolygon", F.from_json(F.get_json_object("geometry", "$.coordinates[0]"), RINGS)[0])
    place = F.when(kind == "Point", F.struct(point[0].alias("lon"), point[1].alias("lat"))).otherwise(centroid(ring))
    country = F.coalesce(get("$.location.localized.en.country"), get("$.country"), get("$.sources[0].country"))
    state = F.coalesce(get("$.location.localized.en.region"), get("$.state"))
    out = features.filter("geometry is not null").select(get("$.name").alias("name"), country.alias("country"), state.alias("state"), F.inline(F.array(place)))
    return out.filter("name is not null and lat is not null").select("name", "lat", "lon", "country", "state")



def lift_elevations(lifts: DataFrame) -> DataFrame:
    """(name, base_elevation, summit_elevation) of each ski area named by lifts with 3-D coordinates."""
    names = F.from_json(F.get_json_object("properties", "$.skiAreas"), "array<struct<properties:struct<name:string>>>")
    points = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<double>>")
    out = lifts.filter("geometry is not null").select(F.explode(names).alias("a"), points.alias("p")).select(F.col("a.properties.name").alias("name"), F.explode("p").alias("x")).filter("size(x) >= 3")
    return out.groupBy("name").agg(F.min(F.col("x")[2]).alias("base_elevation"), F.max(F.col("x")[2]).alias("summit_elevation"))


def resorts(areas: DataFrame, elevations: DataFrame, box: dict = WESTERN_US, countries: list[str] | None = None) -> DataFrame:
    """Areas in a box, with elevations and vertical drop."""
    out = areas.join(elevations, "name", "left").filter(in_box(F.col("lat"), F.col("lon"), box))
    out = out if countries is None else out.filter(F.col("country").isin(*countries))
    return out.withColumn("vertical_drop", F.col("summit_elevation") - F.col("base_elevation"))
