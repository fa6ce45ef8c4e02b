"""Features of GeoJSON files, against Python's own reader, whatever the cuts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from nivalis.sources import resorts
from nivalis.sources.geojson import feature_texts


def collection(n: int, seed: int = 1, **more) -> dict:
    r = random.Random(seed)
    odd = ['a "quoted" } name', "back\\slash\\", "{[", '"features":[{', "ß中😀", "", "}}}", "x" * 700]
    shape = lambda: {"type": "Polygon", "coordinates": [[[r.random(), r.random()] for _ in range(r.randint(1, 6))]]}
    one = lambda i: {"type": "Feature", "properties": {"id": i, "name": r.choice(odd), "features": [{"deep": {}}, {}] if i % 3 else []}, "geometry": shape() if i % 5 else None}
    return {"type": "FeatureCollection", "crs": {"properties": {"features": [{"no": 1}]}}, "links": [{"a": {}}, {}], "features": [one(i) for i in range(n)], **more}


def read(spark, path) -> list:
    return sorted((json.loads(r.text) for r in feature_texts(spark, str(path)).collect()), key=json.dumps)


@pytest.fixture
def cuts(spark):
    """Files are cut at so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(n: int):
        for k in keys:
            spark.conf.set(k, str(n))

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_features_at_any_cuts(spark, tmp_path, cuts, size):
    a, b = collection(12, 1, after={"features": [{"no": 2}]}), collection(5, 2)
    (tmp_path / "a.geojson").write_text(json.dumps(a, indent=2))
    (tmp_path / "b.geojson").write_text(json.dumps(b, ensure_ascii=False) + "\n" + json.dumps(collection(0)) + "\n" + json.dumps(a))
    (tmp_path / "empty.geojson").write_text("")
    (tmp_path / "scalars.geojson").write_text('{"features": [null, 1, "{", {"type": "Feature"}, [{"no": 3}], {}], "bbox": [1, 2]}')
    (tmp_path / "short.geojson").write_text('{"features": [{"id": 1}, {"id": 2, "properties": {"a": {}')
    cuts(size)
    want = a["features"] * 2 + b["features"] + [{"type": "Feature"}, {}, {"id": 1}]
    assert read(spark, tmp_path) == sorted(want, key=json.dumps)


def test_a_large_file_is_many_tasks_work(spark, tmp_path, cuts):
    row = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.concat(F.lit("Area } "), F.col("id").cast("string")).alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(-F.col("id") % 25 - 100.0, F.col("id") % 15 + 32.0).alias("coordinates")).alias("geometry")))
    texts = [r[0] for r in spark.range(100_000).select(row).collect()]
    (tmp_path / "all.geojson").write_text('{"type": "FeatureCollection", "features": [' + ",\n".join(texts) + "]}")
    cuts(1 << 20)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
    whole = spark.read.schema("features array<string>").option("multiLine", "true").json(str(tmp_path)).select(F.explode("features").alias("f"))
    want = resorts.ski_areas(whole.select(F.get_json_object("f", "$.geometry").alias("geometry"), F.get_json_object("f", "$.properties").alias("properties")))
    got = resorts.ski_areas(resorts.read_features(spark, str(tmp_path)))
    total = lambda d: d.agg(F.count("*"), F.count_distinct("name"), F.sum(F.xxhash64("name", "lat", "lon").cast("decimal(38,0)"))).first()
    assert total(got) == total(want) and total(got)[0] == 100_000


def test_geometries_are_parsed_once(spark):
    """However often coordinates are used, a row's plan parses them once: no filter or column has a copy of it."""
    d = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}', '{"name":"a"}'), ('{"type":"Polygon","coordinates":[[[1,1],[3,3],[1,1]]]}', '{"name":"flat"}'), ('{"type":"Polygon","coordinates":[[]]}', '{"name":"none"}'), (None, '{"name":"b"}')], "geometry string, properties string")
    out = resorts.ski_areas(d.repartition(2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("jsontostructs(") <= 4  # a point (either coordinate), a polygon, a polygon of several
    got = {r.name: (r.lat, r.lon) for r in out.collect()}
    assert got == {"a": (1.0, 1.0), "flat": (pytest.approx(5 / 3), pytest.approx(5 / 3))}
