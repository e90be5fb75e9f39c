"""Reference files: ports (CSV), zones (GeoJSON) and watch lists (CSV).

Loaders return the rows and the number of skipped ones. Schemas are never inferred:
everything is read as text and cast. Defined results: unreadable numbers, missing keys
and impossible coordinates skip a row; ragged rows are read as far as they go; a missing
required column is an error; an empty file gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers under which the columns are found, compared without case and separators.
PORT_ALIASES = {
    "wpi_id": ["wpi_id", "index number", "index_no", "world port index number", "port_id"],
    "name": ["name", "main port name", "port name", "portname"],
    "country": ["country", "country code", "countrycode", "country_code"],
    "un_locode": ["un_locode", "unlocode", "un/locode", "locode"],
    "lat": ["lat", "latitude", "latitude_dd", "y"],
    "lon": ["lon", "lng", "longitude", "longitude_dd", "x"],
}
ZONE_KEYS = ["mrgid", "mrgid_eez", "id"]
ZONE_NAMES = ["geoname", "name", "territory1", "eez"]
ZONE_COUNTRIES = ["iso_ter1", "iso_sov1", "iso3", "iso", "country"]
SDN_COLUMNS = "ent_num sdn_name sdn_type program title call_sign vess_type tonnage grt vess_flag vess_owner".split()


def _plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def circle(lon: Column, lat: Column, metres: float, points: int = 32) -> Column:
    """GeoJSON ring of a circle around a point, good to centimetres at kilometres."""
    step = F.sequence(F.lit(0), F.lit(points))
    ring = F.transform(
        step,
        lambda i: F.array(
            lon + F.degrees(F.sin(i * (2 * 3.141592653589793 / points)) * metres / (6_371_008.8 * F.cos(F.radians(lat)))),
            lat + F.degrees(F.cos(i * (2 * 3.141592653589793 / points)) * metres / 6_371_008.8),
        ),
    )
    closed = F.concat(F.slice(ring, 1, points), F.slice(ring, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))


def load_ports(spark: SparkSession, path: str, *, buffer_m: float = 2000.0) -> tuple[DataFrame, int]:
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    known = {_plain(c): c for c in raw.columns}
    found = {k: next((known[_plain(a)] for a in aliases if _plain(a) in known), None) for k, aliases in PORT_ALIASES.items()}
    missing = [k for k, c in found.items() if c is None and k != "un_locode"]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda k: F.trim(F.col(f"`{found[k]}`")) if found[k] else F.lit(None).cast("string")
    rows = raw.select(*[text(k).alias(k) for k in ("wpi_id", "name", "country", "un_locode")], text("lon").try_cast("double").alias("lon"), text("lat").try_cast("double").alias("lat"))
    good = rows.where("wpi_id <> '' and name <> '' and abs(lat) <= 90 and abs(lon) <= 180")
    return good.withColumn("polygon", circle(F.col("lon"), F.col("lat"), buffer_m)), rows.count() - good.count()


def load_zones(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(mrgid, name, country, geometry) of the features of a collection; a Polygon becomes a MultiPolygon."""
    # coordinates stay text: their depth differs between Polygon and MultiPolygon
    shape = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    text = spark.read.text(path, wholetext=True)
    f = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.geometry", F.transform_keys("f.properties", lambda k, _: F.lower(k)).alias("p"))
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("p", F.lit(n))), F.lit("")) for n in names])
    multi = F.when(F.col("geometry.type") == "Polygon", F.concat(F.lit("["), F.col("geometry.coordinates"), F.lit("]"))).when(F.col("geometry.type") == "MultiPolygon", F.col("geometry.coordinates"))
    rows = f.select(first(ZONE_KEYS).try_cast("int").alias("mrgid"), first(ZONE_NAMES).alias("name"), first(ZONE_COUNTRIES).alias("country"), multi.alias("coordinates"))
    good = rows.where("mrgid is not null and name <> '' and coordinates is not null")
    geometry = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.col("coordinates"), F.lit("}"))
    return good.select("mrgid", "name", "country", geometry.alias("geometry")), rows.count() - good.count()


def zone_polygons(zones: DataFrame) -> DataFrame:
    """(id, polygon): one row per polygon of each zone, for containment joins."""
    parts = F.from_json("geometry", "coordinates array<array<array<array<double>>>>")["coordinates"]
    each = zones.select(F.col("mrgid").alias("id"), F.explode(parts).alias("rings"))
    return each.select("id", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))).alias("polygon"))


def load_watch_list(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The first eleven columns of a headerless list; ``-0-`` means empty, short rows are dropped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(12)), {"mode": "PERMISSIVE"})
    # a row has as many fields as it has commas outside quotes, and one more
    width = F.size(F.split(F.regexp_replace("value", r'"(?:[^"]|"")*"', ""), ","))
    rows = lines.select(fields.alias("f"), width.alias("width"))
    good = rows.where("width >= 11")
    clean = lambda i: F.coalesce(F.nullif(F.trim(F.col(f"f.c{i}")), F.lit("-0-")), F.lit(""))
    return good.select(*[clean(i).alias(n) for i, n in enumerate(SDN_COLUMNS)]), rows.count() - good.count()


def listed_vessels(watch_list: DataFrame) -> DataFrame:
    """The vessels of a watch list; the type is compared without case."""
    return watch_list.where(F.lower("sdn_type") == "vessel").select("ent_num", "sdn_name", "call_sign", "vess_flag", "vess_owner", "vess_type")
