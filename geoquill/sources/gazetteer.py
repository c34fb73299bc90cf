"""Scans of gazetteer tables: countries, postcodes and places with their English aliases, and a place dump of tab-separated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Place types that are populated places, and feature codes that are parts or former places.
LOCALITIES = ["locality", "localadmin", "borough"]
NO_PLACES = ["PPLX", "PPLH", "PPLW", "PPLQ"]


def _alive(c: str = "is_current = 1") -> str:
    return f"{c} and is_deprecated = 0 and is_ceased = 0"


def countries(spr: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, name, country, body): current countries with their primary geometry. ``bodies``: id, is_alt, body."""
    own = spr.where("placetype = 'country'").where(_alive()).select("id", "name", "country")
    return own.join(bodies.where("is_alt = 0").select("id", "body"), "id")


def usable_postcode(name: Column, country: Column, lat: Column, lng: Column) -> Column:
    """A name without control characters, a country of two capitals, coordinates on the globe but not at the origin."""
    place = lat.between(-90, 90) & lng.between(-180, 180) & ((lat != 0) | (lng != 0)) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce((name != "") & ~name.rlike("[\t\n\r]") & country.rlike("^[A-Z]{2}$") & place, F.lit(False))


def postcodes(spr: DataFrame) -> DataFrame:
    """(country, postcode, latitude, longitude) of usable postal codes that have not been replaced."""
    rows = spr.where("placetype = 'postalcode' and is_superseded = 0").where(_alive("is_current <> 0"))
    ok = usable_postcode(F.col("name"), F.col("country"), F.col("latitude"), F.col("longitude"))
    return rows.where(ok).select("country", F.col("name").alias("postcode"), "latitude", "longitude")


def places(spr: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, country, latitude, longitude, alias, privateuse): populated places with each of their English names, if any."""
    rows = spr.where(F.col("placetype").isin(LOCALITIES)).where("is_superseded = 0").where(_alive())
    english = names.where("language = 'eng'").select("id", F.col("name").alias("alias"), "privateuse")
    return rows.select("id", "name", "country", "latitude", "longitude").join(english, "id", "left")


def population(body: Column) -> Column:
    """Population of a record's properties, by preference the gazetteer's own; 0 if there is none."""
    at = lambda k: F.get_json_object(body, f"$.properties['{k}']").try_cast("long")
    return F.coalesce(at("wof:population"), at("gn:population"), F.lit(0).cast("long"))


#: Columns of the dump, by position.
DUMP = "id name ascii alternates latitude longitude class code country cc2 admin1 admin2 admin3 admin4 population elevation dem zone modified".split()


def dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a place dump as they are: no header, no quotes."""
    return spark.read.schema(", ".join(f"{c} string" for c in DUMP)).option("sep", "\t").option("quote", "").csv(path)


def populated(rows: DataFrame) -> DataFrame:
    """(name, lat, lng, country_code, population) of populated places; numbered French city districts are none."""
    n, cc = F.col("population").try_cast("long"), F.lower("country")
    district = (cc == "fr") & F.col("name").rlike("^(Paris|Marseille|Lyon) [0-9]")
    kept = rows.where((F.col("class") == "P") & (n > 0) & ~F.col("code").isin(NO_PLACES) & ~district)
    return kept.select("name", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lng"), cc.alias("country_code"), n.alias("population"))
