"""Files of every format, written from the driver's tables and read back, and their DuckDB counterparts."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from geoquill.functions import checks, geo
from geoquill.functions import names as nm
from geoquill.operators import search as se
from geoquill.sources import catalog, gazetteer, osm, ranges, readers, shared, writers

from . import testgeo as tg

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("sc04_national_files", "select cast(o_orderkey as varchar) as address_pid, nullif(case when o_orderkey%5=0 then '' else o_orderpriority end, '') as street, o_orderstatus as status from orders")
def sc04(spark, sf):
    root, k = shared.folder(spark, "psv"), F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(k.cast("string").alias("address_pid"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("street"), F.col("o_orderstatus").alias("status"))
    rows.write.option("sep", "|").option("header", True).csv(root)
    return readers.psv(spark, root, ["address_pid", "street", "status"])


@query("sc05_listed_files", "select distinct concat('n_regionkey=', n_regionkey) as folder from nation")
def sc05(spark, sf):
    root = shared.folder(spark, "files")
    t(spark, sf, "nation").write.partitionBy("n_regionkey").option("header", True).csv(root)
    return catalog.files(spark, root, ".csv").select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


_OPEN = ", case when p_partkey%3=0 then 'us' when p_partkey%3=1 then 'au' else 'nz' end as country_code from part"


def _open_files(spark, sf):
    root, k = shared.folder(spark, "open"), F.col("p_partkey")
    rows = t(spark, sf, "part").select(
        F.concat_ws(" ", k.cast("string"), F.lit('"A", B\nC')).alias("street"), F.when(k % 7 != 0, k.cast("string")).alias("Number"), (k % 90).cast("string").alias("LAT"), (k % 170).cast("string").alias("LON"), k
    )
    for i, cc in enumerate(("us", "au", "nz")):
        part = rows.where(k % 3 == i).drop("p_partkey")
        part = part if i else part.select("LON", "LAT", "Number", "street")  # another order of columns
        part.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/{cc}/state")
    return root


@query("sc06_open_files", "select concat(p_partkey, ' \"A\", B', chr(10), 'C') as street, case when p_partkey%7<>0 then cast(p_partkey as varchar) end as number, cast(p_partkey%90 as varchar) as lat, cast(p_partkey%170 as varchar) as lon" + _OPEN)
def sc06(spark, sf):
    """Quotes and line ends inside fields; headers of any case and order."""
    return readers.open_addresses(spark, _open_files(spark, sf)).select("street", "number", "lat", "lon", "country_code")


@query("sc07_country_folders", f"select country_code, count(*) as n from (select p_partkey{_OPEN}) where country_code in ('us','nz') and country_code<>'nz' group by 1")
def sc07(spark, sf):
    return readers.open_addresses(spark, _open_files(spark, sf), ["us", "nz"], ["nz"]).groupBy("country_code").agg(F.count("*").alias("n"))


@query("f09_usable_rows", "select p_partkey as id, cast(p_partkey%90 as double) as lat, cast(p_partkey%170 as double) as lng from part where p_partkey%7<>0 and not (p_partkey%90=0 and p_partkey%170=0)")
def f09(spark, sf):
    rows = readers.usable_addresses(readers.open_addresses(spark, _open_files(spark, sf)))
    return rows.select(F.col("number").cast("long").alias("id"), "lat", "lng")


@query("sc11_geojson_rings", "select n_nationkey as id, cast(case when n_nationkey%2=0 then 1 else 2 end as int) as rings, cast(n_nationkey as double) as lat from nation")
def sc11(spark, sf):
    k = F.col("n_nationkey")
    ring = lambda d: F.format_string(f"[[0,%d],[{d},%d],[{d},%d],[0,%d]]", k, k, k + 1, k + 1)
    shape = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(1), F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring(1), F.lit("],["), ring(2), F.lit("]]}")))
    rows = t(spark, sf, "nation").select(k.cast("int").alias("id"), readers.rings(F.concat(F.lit('{"geometry":'), shape, F.lit("}"))).alias("r"))
    return rows.select("id", F.size("r").alias("rings"), F.col("r")[0][0]["lat"].alias("lat"))


@query("sc12_versioned_tsv", "select s_suppkey as id, s_name as name, round(s_acctbal, 2) as balance from supplier")
def sc12(spark, sf):
    root = shared.folder(spark, "tsv")
    writers.export_tsv(t(spark, sf, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2)), root, "balances-v1")
    return readers.tsv(spark, root, "id long, name string, balance double", "balances-v1").withColumn("balance", F.round("balance", 2))


_MAPPING = '{"defaults":{"admin":{"2":"country","4":"state","8":"city"}},"countries":{"AU":{"admin":{"4":"ignore"}},"NZ":{"admin":{"8":{"field":"city_if_empty","max_area":2.5}}}}}'


@query("sc14_admin_mapping", "select * from (values (cast(null as varchar),cast(2 as int),'country',cast(null as double)),(null,4,'state',null),(null,8,'city',null),('AU',4,'ignore',null),('NZ',8,'city_if_empty',2.5)) v(country_code,level,field,max_area)")
def sc14(spark, sf):
    root = shared.folder(spark, "mapping")
    spark.range(1).select(F.lit(_MAPPING).alias("value")).coalesce(1).write.text(root)
    return readers.admin_mapping(spark, root)


@query("sc15_index_tables", "select 'nation' as name, count(*) as rows from nation union all select 'region', count(*) from region")
def sc15(spark, sf):
    """An index folder written, published and opened: counts and schemas are those of its manifest."""
    root = shared.folder(spark, "index")
    writers.write_index(spark, root, "v1", {n: t(spark, sf, n) for n in ("nation", "region")})
    return writers.summary(writers.open_index(spark, root))


@query("sk02_published_version", "select 'nation' as name, count(*) as rows, cast(3 as int) as fields from nation where n_regionkey=1")
def sk02(spark, sf):
    """The second version replaces the first by one rename of the pointer."""
    root, n = shared.folder(spark, "index"), t(spark, sf, "nation")
    writers.write_index(spark, root, "v1", {"nation": n})
    writers.write_index(spark, root, "v2", {"nation": n.where("n_regionkey = 1")})
    return writers.manifest(spark, root)


@query("sk01_reverse_tables", tg.cte("places", "pois") + " select 'places' as name, count(*) as rows from places union all select 'pois', count(*) from pois")
def sk01(spark, sf):
    """Entities of the reverse index, near ones together."""
    root = shared.folder(spark, "reverse")
    put = lambda n: tg.table(spark, sf, n).withColumn("cell", geo.cell(F.col("lat"), F.col("lng"), 2).cast("long"))
    writers.write_index(spark, root, "v1", {n: put(n) for n in ("places", "pois")}, cluster={"places": "cell", "pois": "cell"})
    return writers.summary(writers.open_index(spark, root))


@query("sk03_cell_postings", tg.cte("places") + " select cast(floor((lat+90)/2)*1048576+floor((lng+180)/2) as bigint) as cell, id from places")
def sk03(spark, sf):
    root = shared.folder(spark, "postings")
    rows = tg.table(spark, sf, "places").select(geo.cell(F.col("lat"), F.col("lng"), 2).cast("long").alias("cell"), "id")
    writers.write_index(spark, root, "v1", {"entries": rows}, cluster={"entries": "cell"})
    return writers.open_index(spark, root)["entries"]


_POINTS = "select id, source, case when id%2=0 then 'au' else 'nz' end as country_code from addresses"


def _points(spark, sf):
    return tg.table(spark, sf, "addresses").withColumn("country_code", F.when(F.col("id") % 2 == 0, "au").otherwise("nz"))


@query("sk05_address_shards", tg.cte("addresses") + " " + _POINTS)
def sk05(spark, sf):
    root = shared.folder(spark, "addresses")
    writers.address_shards(_points(spark, sf), root)
    return writers.open_address_shards(spark, root).select("id", "source", "country_code")


_FORWARD = "select s_suppkey as doc_id, s_name as name, case when s_suppkey%5=0 then 'unknown' when s_suppkey%2=0 then 'au' else 'nz' end as country_code from supplier"


def _forward(spark, sf, per_country):
    root, k = shared.folder(spark, "forward"), F.col("s_suppkey")
    docs = t(spark, sf, "supplier").select(k.alias("doc_id"), F.col("s_name").alias("name"), F.when(k % 5 != 0, F.when(k % 2 == 0, "AU").otherwise("NZ")).alias("country"))
    writers.forward_index(docs, root, per_country)
    return root


@query("sk06_forward_index", _FORWARD)
def sk06(spark, sf):
    return spark.read.schema("doc_id long, name string, country_code string").parquet(_forward(spark, sf, False))


@query("sc17_country_shards", f"select distinct country_code as shard from ({_FORWARD})")
def sc17(spark, sf):
    return catalog.shards(spark, _forward(spark, sf, True), "country_code")


@query("sc16_one_shard", f"select doc_id, name from ({_FORWARD}) where country_code='nz'")
def sc16(spark, sf):
    """A shard picked by its folder; a part that is not there is empty and typed."""
    root = _forward(spark, sf, True)
    none = readers.optional(spark, root + "-absent", "doc_id long, name string")
    return catalog.shard(spark, root, "doc_id long, name string, country_code string", "country_code", ["NZ"]).select("doc_id", "name").unionByName(none)


_ENTRIES = "select country, key, id, name, cast(rank as int) as rank from (select *, row_number() over (partition by country, key order by rank, id) rn from (select concat('c', cast(p_partkey%5 as int)) country, p_partkey as id, p_name as name, lower(p_name) as key, p_size as rank from part)) where rn=1"


def _completions(spark, sf, per_country):
    root = shared.folder(spark, "completions")
    names = t(spark, sf, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("country"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("rank"))
    writers.autocomplete_index(se.autocomplete_entries(names), root, per_country)
    return root


@query("sk07_completion_index", _ENTRIES)
def sk07(spark, sf):
    return spark.read.schema("country string, key string, id long, name string, rank int").parquet(_completions(spark, sf, False))


@query("sc18_completion_shards", f"select distinct country as shard from ({_ENTRIES})")
def sc18(spark, sf):
    return catalog.shards(spark, _completions(spark, sf, True), "country")


@query("sk08_tsv_export", "select count(*) as n, sum(s_suppkey) as ids from supplier")
def sk08(spark, sf):
    root = shared.folder(spark, "export")
    writers.export_tsv(t(spark, sf, "supplier").select("s_suppkey", "s_name"), root, "suppliers-v1")
    return readers.tsv(spark, root, "id long, name string", "suppliers-v1").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("sk09_csv_dump", tg.cte("places") + " select cast(id as varchar) as id, name, printf('%.6f', lat) as lat, printf('%.6f', lng) as lng from places")
def sk09(spark, sf):
    root = shared.folder(spark, "dump")
    writers.dump_csv(tg.table(spark, sf, "places").select("id", "name", "lat", "lng"), root)
    return spark.read.schema("id string, name string, lat string, lng string").option("header", True).csv(root)


@query("sk10_dump_to_parquet", tg.cte("places") + " select id, name, round(lat,6) as lat, round(lng,6) as lng from places")
def sk10(spark, sf):
    root = shared.folder(spark, "dump")
    writers.dump_csv(tg.table(spark, sf, "places").select("id", "name", "lat", "lng"), f"{root}/csv")
    writers.csv_to_parquet(spark, f"{root}/csv", f"{root}/parquet", "id long, name string, lat double, lng double")
    return spark.read.schema("id long, name string, lat double, lng double").parquet(f"{root}/parquet").select("id", "name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("sk11_manifest", "select 'region' as name, count(*) as rows, cast(2 as int) as fields from region")
def sk11(spark, sf):
    root = shared.folder(spark, "manifest")
    writers.write_index(spark, root, "v1", {"region": t(spark, sf, "region")})
    return writers.manifest(spark, root)


@query("sc19_feature_lines", tg.cte("addresses") + " select housenumber as number, street, unit, city, postcode, round(lat,6) as lat, round(lng,6) as lng from addresses where id%11<>0 and id%13<>0")
def sc19(spark, sf):
    """Compressed lines of features; other shapes and numbers of 0 are dropped."""
    root, k = shared.folder(spark, "features"), F.col("id")
    kind, number = F.when(k % 11 == 0, "Polygon").otherwise("Point"), F.when(k % 13 == 0, "0").otherwise(F.col("housenumber"))
    body = F.to_json(F.struct(F.struct(number.alias("number"), "street", "unit", "city", "postcode").alias("properties"), F.struct(kind.alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry")))
    tg.table(spark, sf, "addresses").select(body.alias("value")).write.option("compression", "gzip").text(root)
    return readers.point_features(spark, root).withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@query("sc20_place_dump", tg.cte("places") + " select case when id%9=0 then 'Paris 12e' else name end as name, round(lat,6) as lat, round(lng,6) as lng, case when id%3=0 then 'fr' else 'au' end as country_code, cast(id%4*1000 as bigint) as population from places where id%5<>0 and id%7<>0 and id%4<>0 and not (id%9=0 and id%3=0)")
def sc20(spark, sf):
    root, k, none = shared.folder(spark, "dump"), F.col("id"), F.lit(None).cast("string")
    have = {"id": k, "name": F.when(k % 9 == 0, "Paris 12e").otherwise(F.col("name")), "latitude": F.format_string("%.6f", "lat"), "longitude": F.format_string("%.6f", "lng"), "class": F.when(k % 5 == 0, "A").otherwise("P"),
            "code": F.when(k % 7 == 0, "PPLX").otherwise("PPL"), "country": F.when(k % 3 == 0, "FR").otherwise("AU"), "population": k % 4 * 1000}
    tg.table(spark, sf, "places").select(*[have.get(c, none).cast("string").alias(c) for c in gazetteer.DUMP]).write.option("sep", "\t").csv(root)
    return gazetteer.populated(gazetteer.dump(spark, root)).withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@query("sc21_external_answers", "select o_orderkey as id, case when o_orderkey%4=0 then 'ZERO_RESULTS' else 'OK' end as status, case when o_orderkey%4<>0 then cast(o_orderkey%80 as double) end as lat, case when o_orderkey%4<>0 then 'AU' end as country from orders")
def sc21(spark, sf):
    k = F.col("o_orderkey")
    hit = F.format_string('[{"geometry":{"location":{"lat":%d,"lng":7}},"address_components":[{"short_name":"X","types":["route"]},{"short_name":"AU","types":["country","political"]}]}]', k % 80)
    body = F.concat(F.lit('{"status":"'), F.when(k % 4 == 0, "ZERO_RESULTS").otherwise("OK"), F.lit('","results":'), F.when(k % 4 == 0, "[]").otherwise(hit), F.lit("}"))
    return t(spark, sf, "orders").select(k.alias("id"), readers.geocode_snapshot(body).alias("s")).select("id", "s.status", "s.lat", "s.country")


_CORPUS = """{"name":"demo","description":"d","cases":[
{"id":"a","tags":["au"],"request":{"path":"/search","query":{"q":"x"}},"expect":{"status":200,"checks":[
 {"kind":"json_path_equals","path":"results.0.name","value":"Main St"},{"kind":"json_path_contains_ci","path":"results.1.name","value":"ROAD"},{"kind":"json_path_exists","path":"results.0.lat"},
 {"kind":"json_path_absent","path":"results.0.unit"},{"kind":"json_path_min_count","path":"results","min":2},{"kind":"result_count","expression":">= 2"},{"kind":"result_count","expression":"3"}]}},
{"id":"b","tags":["nz","hard"],"request":{"path":"/search"},"expect":{"checks":[
 {"kind":"result_matches_within","limit":1,"fields":{"name":"MAIN STREET"},"normalizers":{"name":["toUpperCase","abbreviateStreetSuffixes"]}},
 {"kind":"result_matches_within","limit":2,"fields":{"name_or_address":"5 High Road"},"coordinates":{"lat":10.0,"lng":20.0,"max_m":50.0}},
 {"kind":"result_matches_within","limit":1,"fields":{"name_or_address":"5 High Road"}},{"kind":"result_absent","fields":{"name":"Elsewhere"}},{"kind":"result_absent","fields":{"name":"Main St"}},
 {"kind":"result_coord_within","limit":1,"expected_lat":1.0,"expected_lng":2.0,"max_m":10.0},{"kind":"coord_within_m","lat_path":"results.1.lat","lng_path":"results.1.lon","expected_lat":10.0,"expected_lng":20.01,"max_m":500.0}]}}]}"""
_ANSWER = '{"results":[{"name":"Main St","lat":1.0,"lon":2.0},{"name":"High Road","lat":10.0,"lon":20.0,"address":{"house_number":"5","road":"High Road"}}]}'
_PASSED = {"a": [True, True, True, True, True, True, False], "b": [True, True, False, True, False, True, False]}


def _cases(spark):
    root = shared.folder(spark, "corpus")
    spark.range(1).select(F.lit(_CORPUS.replace("\n", " ")).alias("value")).coalesce(1).write.text(root)
    return readers.regression_cases(spark, root)


@query("sc22_regression_corpus", "select * from (values ('demo','a','au','/search',cast(7 as int)),('demo','b','nz,hard','/search',7)) v(suite,id,tags,path,checks)")
def sc22(spark, sf):
    return _cases(spark).select("suite", "id", F.array_join("tags", ",").alias("tags"), F.col("request.path").alias("path"), F.size("checks").alias("checks"))


@query("r31_regression_checks", "select r_regionkey as answer, id, cast(pos as int) as pos, passed from region, (values " + ",".join(f"('{i}',{k},{str(v).lower()})" for i, vs in _PASSED.items() for k, v in enumerate(vs)) + ") v(id,pos,passed)")
def r31(spark, sf):
    """Ten kinds of checks against answers as JSON text."""
    rows = _cases(spark).select("id", F.posexplode("checks").alias("pos", "check"))
    answers = t(spark, sf, "region").select(F.col("r_regionkey").alias("answer"), F.lit(_ANSWER).alias("body"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("id"))
    return answers.join(rows, "id").select("answer", "id", "pos", checks.passes(F.col("body"), F.col("check")).alias("passed"))


@query("js2_count_expressions", "select p_partkey as id, case p_partkey%6 when 0 then p_size>=10 when 1 then p_size<=10 when 2 then p_size=10 when 3 then p_size>10 when 4 then p_size<10 else p_size=7 end as ok from part")
def js2(spark, sf):
    e = F.get(F.array(*map(F.lit, [">=10", "<= 10", "== 10", ">10", " < 10", "7"])), (F.col("p_partkey") % 6).cast("int"))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), checks.count_matches(F.col("p_size"), e).alias("ok"))


@query("js3_population", "select s_suppkey as id, case when s_suppkey%3=0 then s_suppkey when s_suppkey%3=1 then s_suppkey*2 else 0 end as population from supplier")
def js3(spark, sf):
    k = F.col("s_suppkey")
    body = F.format_string('{"properties":{%s}}', F.when(k % 3 == 0, F.format_string('"wof:population":%d,"gn:population":5', k)).when(k % 3 == 1, F.format_string('"gn:population":%d', k * 2)).otherwise(""))
    return t(spark, sf, "supplier").select(k.alias("id"), gazetteer.population(body).alias("population"))


@query("js4_answer_structs", tg.cte("addresses") + " select id, to_json(case when unit is null then {'number': housenumber, 'road': street} else {'number': housenumber, 'road': street} end) as body from addresses")
def js4(spark, sf):
    """Address parts nested and as text; what is null is left out."""
    return tg.table(spark, sf, "addresses").select("id", F.to_json(F.struct(F.col("housenumber").alias("number"), F.col("street").alias("road"), F.lit(None).cast("string").alias("poi"))).alias("body"))


@query("sc24_replication_state", "select event_id, event_id*3 as sequence, date_trunc('second', ts) as at from events")
def sc24(spark, sf):
    """State texts with escaped colons."""
    e = t(spark, sf, "events")
    body = F.concat(F.lit("#header\nsequenceNumber="), (F.col("event_id") * 3).cast("string"), F.lit("\ntimestamp="), F.replace(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.lit("\\:")), F.lit("\n"))
    return e.select("event_id", readers.replication_state(body).alias("s")).select("event_id", "s.sequence", F.col("s.timestamp").cast("timestamp_ntz").alias("at"))


@query("sc25_source_mix", "select * from (values ('planet','continents beside planet','asia-latest.osm.pbf,europe-latest.osm.pbf'),('europe',null,null),('canada',null,null)) v(region,clash,files)")
def sc25(spark, sf):
    names = spark.createDataFrame([("europe-latest.osm.pbf",), ("asia-latest.osm.pbf",), ("notes.txt",)], "name string")
    return catalog.source_clashes(names, spark.createDataFrame([("planet",), ("europe",), ("canada",)], "region string"))


@query("sc27_region_presets", "select * from (values ('all-continents',cast(9 as bigint)),('planet',1),('usa',1),('niue',1)) v(region,n)")
def sc27(spark, sf):
    return catalog.region_files(spark).where(F.col("region").isin("all-continents", "planet", "usa", "niue")).groupBy("region").agg(F.count("*").alias("n"))


@query("sc28_loaded_parts", tg.cte("addresses") + f" select 'addresses' as part, true as loaded, count(*) as rows, 'au,nz' as countries from ({_POINTS}) union all select 'ranges', false, 0, '' union all select 'region', true, count(*), '' from region")
def sc28(spark, sf):
    parts = catalog.parts({"addresses": _points(spark, sf), "region": t(spark, sf, "region")}, ["addresses", "ranges", "region"])
    return parts.select("part", "loaded", "rows", F.array_join("countries", ",").alias("countries"))


_SPR = """spr as (select p_partkey as id, p_name as name, case when p_partkey%13=0 then 'au' else 'AU' end as country, case p_partkey%4 when 0 then 'country' when 1 then 'postalcode' when 2 then 'locality' else 'region' end as placetype,
 cast(p_partkey%80 as double) as latitude, cast(p_partkey%170 as double) as longitude, cast(case when p_partkey%10=0 then 0 when p_partkey%10=1 then -1 else 1 end as int) as is_current,
 cast(case when p_partkey%11=0 then 1 else 0 end as int) as is_deprecated, cast(0 as int) as is_ceased, cast(case when p_partkey%17=0 then 1 else 0 end as int) as is_superseded from part)"""


def _spr(spark, sf):
    return t(spark, sf, "part").selectExpr(
        "p_partkey id", "p_name name", "case when p_partkey%13=0 then 'au' else 'AU' end country", "case p_partkey%4 when 0 then 'country' when 1 then 'postalcode' when 2 then 'locality' else 'region' end placetype",
        "cast(p_partkey%80 as double) latitude", "cast(p_partkey%170 as double) longitude", "case when p_partkey%10=0 then 0 when p_partkey%10=1 then -1 else 1 end is_current",
        "case when p_partkey%11=0 then 1 else 0 end is_deprecated", "0 is_ceased", "case when p_partkey%17=0 then 1 else 0 end is_superseded",
    )


@query("sc08_gazetteer_countries", f"with {_SPR} select id, name, country, concat('body', id) as body from spr where placetype='country' and is_current=1 and is_deprecated=0 and is_ceased=0 and id%3<>0")
def sc08(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).cast("int").alias("is_alt"), F.concat(F.lit("body"), F.col("p_partkey")).alias("body"))
    return gazetteer.countries(_spr(spark, sf), p)


@query("sc09_gazetteer_postcodes", f"with {_SPR} select country, name as postcode, latitude, longitude from spr where placetype='postalcode' and is_current<>0 and is_deprecated=0 and is_ceased=0 and is_superseded=0 and country='AU' and not (latitude=0 and longitude=0)")
def sc09(spark, sf):
    return gazetteer.postcodes(_spr(spark, sf))


@query("sc10_gazetteer_places", f"with {_SPR} select id, name, country, latitude, longitude, case when id%6=0 then concat('alias', id) end as alias from spr where placetype='locality' and is_current=1 and is_deprecated=0 and is_ceased=0 and is_superseded=0")
def sc10(spark, sf):
    k = F.col("p_partkey")
    n = t(spark, sf, "part").where(k % 3 == 0).select(k.alias("id"), F.when(k % 6 == 0, "eng").otherwise("deu").alias("language"), F.concat(F.lit("alias"), k).alias("name"), F.lit(None).cast("string").alias("privateuse"))
    return gazetteer.places(_spr(spark, sf), n).select("id", "name", "country", "latitude", "longitude", "alias")


@query("x24_alias_table", "select r_regionkey as id, 'name' as family, cast(28261 as int) as lang, concat(r_name, ' EN') as alias from region union all select r_regionkey, 'alt_name', 0, concat('old ', r_name) from region")
def x24(spark, sf):
    tags = F.create_map(F.lit("name"), F.col("r_name"), F.lit("name:en"), F.concat("r_name", F.lit(" EN")), F.lit("alt_name"), F.concat(F.lit("old "), "r_name", F.lit(" ; ")), F.lit("other"), F.lit("x"))
    return t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.inline(nm.alias_rows(tags)))


# --- the map's exchange format, written here with its simplest messages


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(k: int, x) -> bytes:
    return _varint(k << 3) + _varint(x) if isinstance(x, int) else _varint(k << 3 | 2) + _varint(len(x)) + x


def _zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _map_file(nodes, ways, relations) -> bytes:
    """One data blob: nodes (id, lat, lng in 1e-7 degrees), ways (id, refs) and relations (id, ways), tagged "kind"."""
    strings = [b"", b"kind", b"node", b"way", b"relation", b"outer"]
    deltas = lambda xs: b"".join(_varint(_zigzag(b - a)) for a, b in zip([0, *xs], xs, strict=False))
    tag = lambda v: _field(2, _varint(1)) + _field(3, _varint(v))
    group = b"".join(_field(1, _field(1, _zigzag(i)) + tag(2) + _field(8, _zigzag(y)) + _field(9, _zigzag(x))) for i, y, x in nodes)
    group += b"".join(_field(3, _field(1, i) + tag(3) + _field(8, deltas(refs))) for i, refs in ways)
    group += b"".join(_field(4, _field(1, i) + tag(4) + _field(8, _varint(5) * len(m)) + _field(9, deltas(m)) + _field(10, _varint(1) * len(m))) for i, m in relations)
    block = _field(1, b"".join(_field(1, w) for w in strings)) + _field(2, group)
    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = _field(2, len(data)) + _field(3, zlib.compress(data))
        head = _field(1, kind) + _field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def _map_files(spark, sf):
    """A file for each region: its nations are nodes, in order a way, and that way a relation; written by tasks."""
    root = shared.folder(spark, "map")
    rows = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("n"))

    def write(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        for b in batches:
            paths = []
            for r, n in zip(b["r"], b["n"], strict=True):
                fs, at = pafs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
                fs.create_dir(at, recursive=True)
                ids = [int(x) for x in n]
                with fs.open_output_stream(f"{at}/{r}.pbf") as f:
                    f.write(_map_file([(i + 1, i * 10_000_000, -i * 20_000_000) for i in ids], [(100 + int(r), [i + 1 for i in ids])], [(200 + int(r), [100 + int(r)])]))
                paths.append(f"{root}/{r}.pbf")
            yield pd.DataFrame({"path": paths})

    return sorted(r["path"] for r in rows.mapInPandas(write, "path string").collect())


@query("sc01_map_relations", "select cast(200+r_regionkey as bigint) as id, cast(100+r_regionkey as bigint) as member, 'outer' as role from region")
def sc01(spark, sf):
    e = osm.read(spark, _map_files(spark, sf)).where("kind = 'relation'")
    return e.select("id", F.explode("members").alias("m")).select("id", F.col("m.ref").alias("member"), "m.role")


@query("sc02_map_ways", "select cast(100+n_regionkey as bigint) as id, cast(row_number() over (partition by n_regionkey order by n_nationkey)-1 as int) as pos, cast(n_nationkey as double) as lat, cast(-2*n_nationkey as double) as lng from nation")
def sc02(spark, sf):
    """Ways with the places of their nodes, in order."""
    w = osm.ways_with_nodes(osm.read(spark, _map_files(spark, sf)))
    return w.select("id", F.posexplode("nodes").alias("pos", "v")).select("id", "pos", F.round("v.lat", 6).alias("lat"), F.round("v.lng", 6).alias("lng"))


@query("sc03_several_map_files", "select 'node' as kind, count(*) as n from nation union all select 'way', count(*) from region union all select 'relation', count(*) from region")
def sc03(spark, sf):
    return osm.read(spark, _map_files(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


# --- network address databases, written here


def _record(value) -> bytes:
    """A value as a record's field: maps, texts, doubles and numbers."""

    def head(kind: int, size: int) -> bytes:
        low, more = (size, b"") if size < 29 else (29, bytes([size - 29]))
        return (bytes([kind << 5 | low]) if kind < 8 else bytes([low, kind - 7])) + more

    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(_record(k) + _record(v) for k, v in value.items())
    if isinstance(value, str):
        raw = value.encode()
        return head(2, len(raw)) + raw
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6, len(raw)) + raw


def address_database(entries: list[tuple[int, int, dict]], bits: int, six: bool) -> bytes:
    """A database of (address, prefix length, record), with records of 24, 28 or 32 bits, for addresses of four or sixteen bytes."""
    nodes, data, where = [[None, None]], b"", {}
    for address, length, record in entries:
        path = [0] * (96 if six else 0) + [address >> (31 - k) & 1 for k in range(length)]
        node = 0
        for bit in path[:-1]:
            if nodes[node][bit] is None:
                nodes.append([None, None])
                nodes[node][bit] = len(nodes) - 1
            node = nodes[node][bit]
        key = repr(record)
        if key not in where:
            where[key] = len(data)
            data += _record(record)
        nodes[node][path[-1]] = ("data", where[key])
    n, tree = len(nodes), b""
    for pair in nodes:
        a, b = (n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x for x in pair)
        w = bits // 8
        tree += a.to_bytes(4, "big")[1:] + bytes([(a >> 24) << 4 | b >> 24]) + b.to_bytes(4, "big")[1:] if bits == 28 else a.to_bytes(w, "big") + b.to_bytes(w, "big")
    meta = {"node_count": n, "record_size": bits, "ip_version": 6 if six else 4}
    return tree + bytes(16) + data + ranges.MARK + _record(meta)


@query("sc13_address_ranges", tg.cte("places") + " select bits, id*1024 as lo, id*1024+1023 as hi, case when id%2=0 then 'AU' else 'NZ' end as country, round(lat,6) as lat, round(lng,6) as lng from places, (values (24),(28),(32)) b(bits) union all select bits, 3221225472, 3758096383, 'US', 1.5, 2.5 from (values (24),(28),(32)) b(bits)")
def sc13(spark, sf):
    """Ranges of a database file, in all three record sizes; one range is wider than a byte."""
    rows = tg.table(spark, sf, "places").select("id", "lat", "lng").orderBy("id").collect()
    entries = [(r.id * 1024, 22, {"country": {"iso_code": "NZ" if r.id % 2 else "AU"}, "location": {"latitude": r.lat, "longitude": r.lng}}) for r in rows]
    entries.append((0xC0000000, 3, {"country": {"iso_code": "US"}, "location": {"latitude": 1.5, "longitude": 2.5}}))
    out = None
    for bits in (24, 28, 32):
        root = shared.folder(spark, "ranges")
        one = spark.createDataFrame([(bytearray(address_database(entries, bits, bits != 24)),)], "content binary")

        def write(batches, root=root):
            import pyarrow.fs as pafs

            for b in batches:
                fs, at = pafs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
                fs.create_dir(at, recursive=True)
                with fs.open_output_stream(f"{at}/ranges.db") as f:
                    f.write(bytes(b["content"].iloc[0]))
                yield b.assign(n=1)[["n"]]

        one.mapInPandas(write, "n int").collect()
        got = ranges.read(spark, f"{root}/ranges.db").select(F.lit(bits).alias("bits"), "lo", "hi", "country", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
        out = got if out is None else out.unionByName(got)
    return out
