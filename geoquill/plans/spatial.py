"""Spatial queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.functions import geo
from geoquill.operators import spatial as op

from . import testgeo as tg

Q: dict = {}
SQL: dict = {}

HAV = "2*6371000.0*asin(sqrt(least(1.0, power(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*power(sin(radians({b}.lng-{a}.lng)/2),2))))"
DSQ = "(power(radians({a}.lat-{b}.lat),2)+power(radians(({a}.lng-{b}.lng)-360*round(({a}.lng-{b}.lng)/360))*cos(radians({a}.lat)),2))"
#: Neighbouring cells of ``deg`` degrees, longitudes wrapped.
NEAR = "abs(floor(({a}.lat+90)/{g})-floor(({b}.lat+90)/{g}))<=1 and (abs(floor(({a}.lng+180)/{g})-floor(({b}.lng+180)/{g}))<=1 or abs(floor(({a}.lng+180)/{g})-floor(({b}.lng+180)/{g}))>={w})"


def near(a: str, b: str, g: float) -> str:
    return NEAR.format(a=a, b=b, g=g, w=round(360 / g) - 1)


def query(name: str, sql: str | None = None):
    def wrap(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


INSIDE = "{p}.y0 <= q.lat and q.lat < {p}.y1 and {p}.x0 <= q.lng and q.lng < {p}.x1"
LEVELS = tg.cte("coords", "boxes", "polys") + f", hits as (select q.qid, p.*, row_number() over (partition by q.qid, p.level order by p.area, p.id) rn from coords q join polys p on {INSIDE.format(p='p')}), lv as (select * from hits where rn=1)"
MAPPING = [(None, 2, "country", None), (None, 4, "state", None), (None, 8, "city", None), ("N3", 4, "ignore", None), ("N4", 8, "city", 100.0), ("N5", 8, "county_if_empty", None)]


def _mapping(spark):
    return spark.createDataFrame(MAPPING, "country_code string, level int, field string, max_area double")


def _levels(spark, sf):
    hits = op.point_in_polygon(tg.table(spark, sf, "coords"), tg.polygons(spark, sf), 4.0)
    return op.smallest_by_level(hits).withColumn("country_code", F.concat(F.lit("N"), F.col("k").cast("string")))


@query("j04_reverse_admin", LEVELS + """, f as (select qid, max(case when level=2 then name end) country,
 max(case when level=4 and k<>3 then name end) state, max(case when level=8 and k not in (4,5) then name end) city,
 max(case when level=8 and k=5 then name end) county from lv group by qid)
 select qid, country, state, county, city, nullif(concat_ws(', ', city, country), '') as formatted from f""")  # fmt: skip
def j04(spark, sf):
    """Polygons around each coordinate, the smallest of each level, mapped to fields and a display line."""
    f = op.admin_fields(_levels(spark, sf), _mapping(spark))
    none = F.lit(None).cast("string")
    return f.select("qid", "country", "state", "county", "city", op.format_address(none, none, F.col("city"), F.col("state"), none, F.col("country"), none).alias("formatted"))


@query("a01_smallest_polygon_by_level", LEVELS + " select qid, level, id, round(area,4) area from lv")
def a01(spark, sf):
    return _levels(spark, sf).select("qid", "level", "id", F.round("area", 4).alias("area"))


@query("j06_find_place", tg.cte("coords", "places") + f", r as (select q.qid, p.id, p.rank, round({HAV.format(a='q', b='p')},3) as metres, row_number() over (partition by q.qid order by p.rank, {DSQ.format(a='q', b='p')}, p.id) rn from coords q join places p on {near('q', 'p', 20)}) select qid, id, rank, metres from r where rn=1")
def j06(spark, sf):
    rows = op.nearest_ranked(tg.table(spark, sf, "coords"), tg.table(spark, sf, "places").select("id", "lat", "lng", "rank"), 20)
    return rows.select("qid", "id", "rank", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")), 3).alias("metres"))


@query("j07_find_poi", tg.cte("coords", "pois") + f", r as (select q.qid, p.id, p.category, row_number() over (partition by q.qid order by p.rank, {DSQ.format(a='q', b='p')}, p.id) rn from coords q join pois p on {near('q', 'p', 5)} where {DSQ.format(a='q', b='p')} <= {geo.cutoff(300000)}) select qid, id, category from r where rn=1")
def j07(spark, sf):
    return op.nearest_ranked(tg.table(spark, sf, "coords"), tg.table(spark, sf, "pois").drop("name"), 5, 300_000).select("qid", "id", "category")


ADDR_NEAR = f"select q.qid, p.*, {DSQ.format(a='q', b='p')} as dd from coords q join addresses p on {near('q', 'p', 1)}"


@query("j01_nearest_address", tg.cte("coords", "addresses") + f", r as ({ADDR_NEAR}), s as (select *, row_number() over (partition by qid order by dd, id) rn from r) select qid, id, housenumber, street, round(6371000.0*sqrt(dd),3) metres from s where rn=1")
def j01(spark, sf):
    rows = op.nearest(tg.table(spark, sf, "coords"), tg.table(spark, sf, "addresses").select("id", "lat", "lng", "housenumber", "street"), 1)
    return rows.select("qid", "id", "housenumber", "street", F.round(geo.metres(F.col("d")), 3).alias("metres"))


SEG = """, seg as (select id, name, start_no, end_no, kind, 0 as seg, lat0 a_lat, lng0 a_lng, lat0+1*dlat b_lat, lng0+1*dlng b_lng from ways union all
 select id, name, start_no, end_no, kind, 1, lat0+1*dlat, lng0+1*dlng, lat0+3*dlat, lng0+2*dlng from ways), sz as (select *, 2*6371000.0*asin(sqrt(least(1.0,power(sin(radians(b_lat-a_lat)/2),2)+cos(radians(a_lat))*cos(radians(b_lat))*power(sin(radians(b_lng-a_lng)/2),2)))) size from seg),
 tot as (select *, coalesce(sum(size) over (partition by id order by seg rows between unbounded preceding and 1 preceding),0) bef, sum(size) over (partition by id) total from sz),
 c as (select q.qid, q.lat, q.lng, s.*, cos(radians(q.lat)) k from coords q join tot s on floor((q.lat+90)/2)-1 <= floor((greatest(a_lat,b_lat)+90)/2) and floor((q.lat+90)/2)+1 >= floor((least(a_lat,b_lat)+90)/2)
  and floor((q.lng+180)/2)-1 <= floor((greatest(a_lng,b_lng)+180)/2) and floor((q.lng+180)/2)+1 >= floor((least(a_lng,b_lng)+180)/2)),
 t as (select *, case when power((b_lng-a_lng)*k,2)+power(b_lat-a_lat,2)=0 then 0.0 else greatest(0.0,least(1.0,((lng-a_lng)*k*(b_lng-a_lng)*k+(lat-a_lat)*(b_lat-a_lat))/(power((b_lng-a_lng)*k,2)+power(b_lat-a_lat,2)))) end foot from c),
 d as (select *, power(radians(lat-(a_lat+foot*(b_lat-a_lat))),2)+power(radians(lng-(a_lng+foot*(b_lng-a_lng)))*k,2) dd from t),
 r as (select *, row_number() over (partition by qid order by dd, id, seg) rn from d)"""  # fmt: skip


@query("j02_nearest_street", tg.cte("coords", "ways") + SEG + " select qid, id, name, round(6371000.0*sqrt(dd),2) metres from r where rn=1")
def j02(spark, sf):
    rows = op.nearest_way(tg.table(spark, sf, "coords"), tg.ways(spark, sf).select("id", "name", "nodes"), 2, arc=False)
    return rows.select("qid", "id", "name", F.round(geo.metres(F.col("d")), 2).alias("metres"))


@query("j03_interpolated_number", tg.cte("coords", "ways") + SEG + ", n as (select qid, id, start_no, end_no, kind, case when total=0 then 0.0 else (bef+foot*size)/total end t from r where rn=1) select qid, id, round(t,4) t, case when kind=0 then cast(round(start_no+t*(end_no-start_no)) as bigint) else cast(start_no+greatest(0.0,round(t*(end_no-start_no)/2))*2 as bigint) end as house from n")
def j03(spark, sf):
    rows = op.nearest_way(tg.table(spark, sf, "coords"), tg.ways(spark, sf).drop("name"), 2)
    number = geo.interpolated_number(F.col("start_no"), F.col("end_no"), F.col("t"), F.col("kind"))
    return rows.select("qid", "id", F.round("t", 4).alias("t"), number.alias("house"))


@query("j05_city_fallback", LEVELS + f""", pl as (select * from (select q.qid, p.id pid, p.name pname, p.lat plat, p.lng plng, row_number() over (partition by q.qid order by p.rank, {DSQ.format(a='q', b='p')}, p.id) rn from coords q join (select {tg.TABLES['places'][1]} from supplier) p on {near('q', 'p', 20)}) where rn=1),
 cc as (select qid, max(case when level=2 then k end) k, max(case when level=8 then name end) city from lv group by qid)
 select c.qid, coalesce(c.city, case when floor((plat+60)/24)*5+floor((plng+170)/68) = c.k then pname end) city from cc c left join pl using (qid)""")  # fmt: skip
def j05(spark, sf):
    """A city from the nearest place only if that lies in the same country."""
    c = _levels(spark, sf).groupBy("qid").agg(F.max(F.when(F.col("level") == 2, F.col("k"))).alias("k"), F.max(F.when(F.col("level") == 8, F.col("name"))).alias("city"))
    pl = op.nearest_ranked(tg.table(spark, sf, "coords"), tg.table(spark, sf, "places").drop("importance"), 20).select(F.col("qid"), F.col("name").alias("pname"), F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"))
    same = op.point_in_polygon(pl, tg.polygons(spark, sf).where("level = 2").select("id", "ring", F.col("k").alias("pk")), 4.0).select("qid", "pname", "pk")
    return c.join(same, (c["qid"] == same["qid"]) & (c["k"] == same["pk"]), "left").select(c["qid"], F.coalesce("city", "pname").alias("city"))


@query("j08_source_ladder", tg.cte("coords", "addresses") + f", r as ({ADDR_NEAR}), s as (select *, row_number() over (partition by qid order by source, case when unit is null then 1 else 0 end, dd, id) rn from r where not (source = 0 and qid % 2 = 0)) select qid, id, source from s where rn=1")
def j08(spark, sf):
    """First source that answers: the national file only for its own country, then the open one, then the map."""
    bare = F.col("unit").isNull().cast("int")
    own = F.when(F.col("qid") % 2 == 0, F.lit(~3)).otherwise(F.lit(-1)).cast("long")
    order = [F.col("source"), bare, F.col("d"), F.col("id")]
    a = tg.table(spark, sf, "addresses").select("id", "lat", "lng", "source", "unit")
    return op.nearest_on_ladder(tg.table(spark, sf, "coords"), a, 1, 2 * F.col("source") + bare, own, order).select("qid", "id", "source")


@query("j10_nearest_across_shards", tg.cte("coords", "addresses") + f", r as ({ADDR_NEAR}), s as (select *, row_number() over (partition by qid, source order by dd, id) rn from r), t as (select *, row_number() over (partition by qid order by dd, id) best from s where rn=1) select qid, id, source from t where best=1")
def j10(spark, sf):
    """Nearest point of each shard, then the nearest of those."""
    q, a = tg.table(spark, sf, "coords"), tg.table(spark, sf, "addresses").select("id", "lat", "lng", "source")
    found = None
    for s in range(3):
        one = op.nearest(q, a.where(F.col("source") == s), 1)
        found = one if found is None else found.unionByName(one)
    return op.best(found, ["qid"], [F.col("d"), F.col("id")]).select("qid", "id", "source")


@query("j12_country_by_box", tg.cte("coords", "boxes", "polys") + f" select q.qid, p.id, p.name from coords q join polys p on p.level=2 and {INSIDE.format(p='p')}")
def j12(spark, sf):
    hits = op.point_in_polygon(tg.table(spark, sf, "coords"), tg.polygons(spark, sf).where("level = 2"), 8.0)
    return op.best(hits, ["qid"], [F.col("area").desc(), F.col("id")]).select("qid", "id", "name")


@query("r23_nearby", tg.cte("coords", "places") + f", r as (select q.qid, p.id, round({HAV.format(a='q', b='p')},3) metres from coords q join places p on abs(q.lat-p.lat)<20 where {HAV.format(a='q', b='p')} <= 1500000), s as (select *, row_number() over (partition by qid order by metres, id) pos from r) select qid, id, metres, cast(pos as bigint) pos from s where pos <= 5")
def r23(spark, sf):
    """All places within a radius, nearest first; the limit is the request's."""
    rows = op.within_radius(tg.table(spark, sf, "coords"), tg.table(spark, sf, "places").select("id", "lat", "lng"), 15, 1_500_000, 5)
    return rows.select("qid", "id", F.round("metres", 3).alias("metres"), F.col("rn").cast("long").alias("pos"))


@query("j32_ip_to_place", tg.cte("coords", "places") + f", ip as (select qid, qid*7919 % 100000 as ip from coords), rng as (select id, name, id*900 lo, id*900+700 hi from places) select ip.qid, ip.ip, rng.id, rng.name from ip join rng on ip.ip between lo and hi")
def j32(spark, sf):
    """Address to range by bucketed ranges: a range is listed in each bucket that it touches, so the join is by equality."""
    ip = tg.table(spark, sf, "coords").select("qid", (F.col("qid") * 7919 % 100000).alias("ip"))
    rng = tg.table(spark, sf, "places").select("id", "name", (F.col("id") * 900).alias("lo"), (F.col("id") * 900 + 700).alias("hi"))
    from geoquill.operators.relational import range_join

    return range_join(ip, rng, "ip", "lo", "hi", 1024).select("qid", "ip", "id", "name")


@query("g25_ring_measures", tg.cte("boxes", "polys") + " select id, round((y1-y0)*(x1-x0),4) area, round((y0+y1)/2,4) lat, round((x0+x1)/2,4) lng, y0 lat0, x0 lng0, y1 lat1, x1 lng1 from polys")
def g25(spark, sf):
    p = tg.polygons(spark, sf)
    c, b = geo.centroid(F.col("ring")), geo.bbox(F.col("ring"))
    return p.select("id", F.round(geo.ring_area(F.col("ring")), 4).alias("area"), F.round(c["lat"], 4).alias("lat"), F.round(c["lng"], 4).alias("lng"), *[b[x].alias(x) for x in ("lat0", "lng0", "lat1", "lng1")])


@query("g14_importance", "select o_orderkey as id, cast(least(255, case when o_totalprice > 0 then floor(greatest(0.0, least(1.0, log10(o_totalprice)/8))*100) else 0 end + case when o_orderkey%3=0 then 30 else 0 end + case when o_orderkey%5=0 then 50 else 0 end) as int) as importance from orders")
def g14(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), geo.importance(F.col("o_totalprice"), F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 == 0).alias("importance"))


@query("g12_buckets", tg.cte("coords") + " select floor(lat*10+0.5) as b_lat, floor(lng*2.5+0.5) as b_lng, count(*) as n from coords group by 1, 2")
def g12(spark, sf):
    q = tg.table(spark, sf, "coords")
    return q.groupBy(F.floor(F.col("lat") * 10 + 0.5).cast("double").alias("b_lat"), F.floor(F.col("lng") * 2.5 + 0.5).cast("double").alias("b_lng")).agg(F.count("*").alias("n"))


@query("w03_arc_lengths", tg.cte("ways") + SEG.split(", c as")[0].rstrip().rstrip(",") + " select id, seg, round(size,3) size, round(bef,3) before, round(total,3) total from tot")
def w03(spark, sf):
    s = op.segments(tg.ways(spark, sf))
    return s.select("id", "seg", F.round("size", 3).alias("size"), F.round("before", 3).alias("before"), F.round("total", 3).alias("total"))


@query("t11_cells", tg.cte("places") + " select cast(floor((lat+90)/2)*1048576+floor((lng+180)/2) as bigint) as cell, count(*) as n, min(id) as first_id from places group by 1")
def t11(spark, sf):
    """Posting lists by cell, sizes and least ids."""
    p = tg.table(spark, sf, "places").withColumn("cell", geo.cell(F.col("lat"), F.col("lng"), 2).cast("long"))
    return p.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))

