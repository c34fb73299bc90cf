"""Regression checks on answers held as JSON text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo
from .names import normalize

#: A check of any kind; what a kind does not use is null.
CHECK = (
    "struct<kind:string,path:string,value:string,min:int,limit:int,fields:map<string,string>,normalizers:map<string,array<string>>,coordinates:struct<lat:double,lng:double,max_m:double>,"
    "expected_lat:double,expected_lng:double,max_m:double,expression:string,lat_path:string,lng_path:string>"
)
CORPUS = f"struct<name:string,description:string,cases:array<struct<id:string,tags:array<string>,request:struct<method:string,path:string,query:map<string,string>>,expect:struct<status:int,checks:array<{CHECK}>>>>>"


def lookup(body: Column, path: Column) -> Column:
    """Value at a dotted path whose numbers are positions: "results.0.name"."""
    return F.call_function("get_json_object", body, F.concat(F.lit("$"), F.array_join(F.transform(F.split(path, r"\."), lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("['"), s, F.lit("']")))), "")))


def _number(body: Column, path: Column) -> Column:
    return lookup(body, path).try_cast("double")


def results(body: Column) -> Column:
    """The results of an answer as an array of JSON texts, null if there is none."""
    return F.from_json(F.get_json_object(body, "$.results"), "array<string>")


def count_matches(n: Column, expression: Column) -> Column:
    """Whether a count fits ">= 2", "<5", "== 1" or a bare number; null for anything else."""
    op, k = F.regexp_extract(expression, r"^\s*(>=|<=|==|>|<)?\s*([0-9]+)\s*$", 1), F.regexp_extract(expression, r"^\s*(>=|<=|==|>|<)?\s*([0-9]+)\s*$", 2).try_cast("int")
    return F.when(op == ">=", n >= k).when(op == "<=", n <= k).when(op == ">", n > k).when(op == "<", n < k).otherwise(n == k)


def _near(hit: Column, lat: Column, lng: Column, most: Column, path_lat: str = "$.lat", path_lng: str = "$.lon") -> Column:
    a, b = F.get_json_object(hit, path_lat).try_cast("double"), F.get_json_object(hit, path_lng).try_cast("double")
    return F.coalesce(geo.haversine(a, b, lat, lng) <= most, F.lit(False))


def _fields_match(hit: Column, fields: Column, chains: Column) -> Column:
    """All fields equal after their normalizers; name_or_address is number and road, or else the name."""

    def one(e: Column) -> Column:
        number, road = F.get_json_object(hit, "$.address.house_number"), F.get_json_object(hit, "$.address.road")
        named = F.coalesce(F.when(number.isNotNull() & road.isNotNull(), F.concat_ws(" ", number, road)), F.get_json_object(hit, "$.name"))
        actual = F.when(e["key"] == "name_or_address", named).otherwise(lookup(hit, e["key"]))
        chain = F.try_element_at(chains, e["key"])
        return F.coalesce(normalize(actual, chain) == normalize(e["value"], chain), F.lit(False))

    return F.forall(F.map_entries(fields), one)


def passes(body: Column, check: Column) -> Column:
    """Whether an answer passes a check of any of the ten kinds; a missing path fails all but an absence."""
    kind, got, hits = check["kind"], lookup(body, check["path"]), results(body)
    first = F.slice(hits, F.lit(1), F.coalesce(check["limit"], F.lit(0)))
    spot = check["coordinates"]
    whole = lambda h: _fields_match(h, check["fields"], check["normalizers"]) & (spot.isNull() | _near(h, spot["lat"], spot["lng"], spot["max_m"]))
    out = (
        F.when(kind == "json_path_equals", got == check["value"])
        .when(kind == "json_path_contains_ci", F.contains(F.lower(got), F.lower(check["value"])))
        .when(kind == "json_path_exists", got.isNotNull())
        .when(kind == "json_path_absent", got.isNull())
        .when(kind == "json_path_min_count", F.json_array_length(got) >= check["min"])
        .when(kind == "result_matches_within", F.exists(first, whole))
        .when(kind == "result_absent", ~F.exists(hits, lambda h: _fields_match(h, check["fields"], check["normalizers"])))
        .when(kind == "result_coord_within", F.exists(first, lambda h: _near(h, check["expected_lat"], check["expected_lng"], check["max_m"])))
        .when(kind == "result_count", count_matches(F.size(hits), check["expression"]) & hits.isNotNull())
        .when(kind == "coord_within_m", geo.haversine(_number(body, check["lat_path"]), _number(body, check["lng_path"]), check["expected_lat"], check["expected_lng"]) <= check["max_m"])
    )
    return F.coalesce(out, F.lit(False))
