"""Further joins, aggregates, orders and checks of the inventory, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoquill.functions import geo
from geoquill.functions import text as tx
from geoquill.operators import relational as rel
from geoquill.operators import search as se
from geoquill.operators import addresses as adr
from geoquill.operators import spatial as sp

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


@query("f04_admin_levels", "select p_partkey as id, case when p_size<=10 then p_size else 11 end as level, coalesce(case when p_size>10 then p_brand end, p_name) as name from part where p_size between 2 and 10 or p_size=50")
def f04(spark, sf):
    s = F.col("p_size")
    return t(spark, sf, "part").where(s.between(2, 10) | (s == 50)).select(F.col("p_partkey").alias("id"), F.when(s <= 10, s).otherwise(11).alias("level"), F.coalesce(F.when(s > 10, F.col("p_brand")), F.col("p_name")).alias("name"))


@query("f06_interpolation_kinds", "select l_orderkey as id, l_linenumber as line, case l_returnflag when 'A' then 0 when 'N' then 2 end as kind from lineitem where l_returnflag in ('A','N')")
def f06(spark, sf):
    f = F.col("l_returnflag")
    return t(spark, sf, "lineitem").where(f.isin("A", "N")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(f == "A", 0).otherwise(2).alias("kind"))


@query("f08_active_rows", "select o_orderkey as id from orders where o_orderstatus<>'P' and trim(o_orderpriority)<>'' and o_orderdate is not null")
def f08(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus <> 'P' and trim(o_orderpriority) <> '' and o_orderdate is not null").select(F.col("o_orderkey").alias("id"))


@query("f10_usable_postcodes", tg.cte("addresses") + " select distinct postcode from addresses where postcode is not null and length(postcode) between 3 and 10 and regexp_matches(postcode,'[0-9]') and postcode<>'1007'")
def f10(spark, sf):
    p = F.col("postcode")
    return tg.table(spark, sf, "addresses").where(p.isNotNull() & F.length(p).between(3, 10) & p.rlike("[0-9]") & (p != "1007")).select("postcode").distinct()


@query("f12_populated_places", "select s_suppkey as id from supplier where s_acctbal>0 and s_nationkey not in (3,7) and not regexp_matches(s_name,'9[0-9]$')")
def f12(spark, sf):
    return t(spark, sf, "supplier").where((F.col("s_acctbal") > 0) & ~F.col("s_nationkey").isin(3, 7) & ~F.col("s_name").rlike("9[0-9]$")).select(F.col("s_suppkey").alias("id"))


@query("f16_area_caps", tg.cte("boxes", "polys") + " select id, level from polys where not (level=4 and area > 500)")
def f16(spark, sf):
    caps = spark.createDataFrame([(4, 500.0)], "level int, max_area double")
    return tg.polygons(spark, sf).join(F.broadcast(caps), "level", "left").where("max_area is null or area <= max_area").select("id", "level")


@query("f18_all_terms", "select doc_id from documents where len(list_filter(['the','and','of'], lambda w: not list_contains(regexp_split_to_array(lower(text),'[^\\p{L}\\p{N}]+'), w)))=0")
def f18(spark, sf):
    d = t(spark, sf, "documents")
    index = se.postings(d.select("doc_id", "text"), ["text"], [])
    terms = spark.createDataFrame([("the",), ("and",), ("of",)], "term string")
    return index.join(F.broadcast(terms), "term").groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where("n = 3").select("doc_id")


@query("f23_requested_address", tg.cte("addresses") + " select id from addresses where lower(street)='street 7' and housenumber='8' and coalesce(unit,'') in ('', '3')")
def f23(spark, sf):
    """Every supplied field equal after normalisation; a field that is not supplied decides nothing."""
    want = {"street": "STREET  7", "housenumber": "8", "postcode": None}
    a, cond = tg.table(spark, sf, "addresses"), F.lit(True)
    for c, v in want.items():
        if v is not None:
            cond = cond & (tx.key(F.col(c)) == tx.key(F.lit(v)))
    return a.where(cond & F.coalesce("unit", F.lit("")).isin("", "3")).select("id")


@query("f28_limits", "select event_id, greatest(1, least(50, user_id % 120 - 10)) as n from events")
def f28(spark, sf):
    return t(spark, sf, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(50), F.col("user_id") % 120 - 10)).alias("n"))


@query("j09_house_lookup", tg.cte("coords", "addresses") + ", q as (select * from coords), c as (select q.qid, p.id, p.unit, power(radians(q.lat-p.lat),2)+power(radians((q.lng-p.lng)-360*round((q.lng-p.lng)/360))*cos(radians(q.lat)),2) d, cast(regexp_extract(split_part(housenumber,'-',1),'^(\\d+)',1) as bigint) f, cast(regexp_extract(case when position('-' in housenumber)>0 then split_part(housenumber,'-',2) else housenumber end,'^(\\d+)',1) as bigint) l from q join addresses p on abs(floor((q.lat+90)/2)-floor((p.lat+90)/2))<=1 and (abs(floor((q.lng+180)/2)-floor((p.lng+180)/2))<=1 or abs(floor((q.lng+180)/2)-floor((p.lng+180)/2))>=179)), r as (select *, row_number() over (partition by qid order by case when unit is null then 0 else 1 end, d, id) rn from c where f<=qid%90+1 and l>=qid%90+1) select qid, id from r where rn=1")
def j09(spark, sf):
    """Nearest address whose number or range holds the one asked for, without a unit first."""
    coords = tg.table(spark, sf, "coords").withColumn("q_house", (F.col("qid") % 90 + 1).cast("string"))
    q, p = adr.by_house(coords, tg.table(spark, sf, "addresses").select("id", "lat", "lng", "housenumber", "unit"))
    with_unit = F.col("unit").isNotNull().cast("int")
    return sp.nearest_on_ladder(q, p, 2, with_unit, None, [with_unit, F.col("d"), F.col("id")], ("_house",)).select("qid", "id")


@query("j13_names_by_language", "select n_nationkey as id, coalesce(case when n_nationkey%2=0 then concat(n_name,'_fr') end, n_name) as name from nation")
def j13(spark, sf):
    """Four-part key look-up of a name in a language, the own name where there is none."""
    n = t(spark, sf, "nation")
    alias = n.where("n_nationkey % 2 = 0").select(F.lit(0).alias("entity"), F.lit("name").alias("kind"), F.lit("fr").alias("lang"), F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit("_fr")).alias("alias"))
    want = n.select(F.col("n_nationkey").alias("id"), "n_name", F.lit(0).alias("entity"), F.lit("name").alias("kind"), F.lit("fr").alias("lang"))
    return want.join(alias, ["entity", "kind", "lang", "id"], "left").select("id", F.coalesce("alias", "n_name").alias("name"))


@query("j14_all_names", "select n_regionkey as id, array_to_string(list(n_name order by n_name), '|') as names from nation group by 1")
def j14(spark, sf):
    g = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("n"))
    return g.select("id", F.array_join("n", "|").alias("names"))


@query("j19_endpoints", "with w as (select cast(trunc(l_extendedprice*10) as bigint) k, max(l_orderkey*10+l_linenumber) last from lineitem group by 1) select l_orderkey as id, l_linenumber as line, w.last from lineitem join w on cast(trunc(l_extendedprice*10) as bigint)=w.k where l_linenumber=1")
def j19(spark, sf):
    """Endpoints meet on truncated coordinates; of equal ones the last written wins."""
    li = t(spark, sf, "lineitem").withColumn("k", (F.col("l_extendedprice") * 10).cast("long")).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    last = li.groupBy("k").agg(F.max("o").alias("last"))
    return li.where("l_linenumber = 1").join(last, "k").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "last")


@query("j23_holes_that_are_rings", "with r as (select l_orderkey k, array_to_string(list_sort(list_distinct(list(l_partkey))),',') sig from lineitem group by 1) select k as id from r where k%2=1 and sig not in (select sig from r where k%2=0)")
def j23(spark, sf):
    """Holes whose ring is not some outer ring: identity is the sorted set of their nodes."""
    r = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("nodes"))
    return r.where("id % 2 = 1").join(r.where("id % 2 = 0").select("nodes").distinct(), "nodes", "left_anti").select("id")


@query("j25_unnamed_polygons", tg.cte("boxes", "polys", "places") + " select p.id from polys p where not exists (select 1 from places s where s.lat>=p.y0 and s.lat<p.y1 and s.lng>=p.x0 and s.lng<p.x1)")
def j25(spark, sf):
    """Polygons without a place inside."""
    poly = tg.polygons(spark, sf)
    hit = sp.point_in_polygon(tg.table(spark, sf, "places").select(F.col("id").alias("qid"), "lat", "lng"), poly, 4.0).select("id").distinct()
    return poly.join(hit, "id", "left_anti").select("id")


@query("j27_source_precedence", tg.cte("addresses") + " select id, source from addresses where source=0 or city not in (select city from addresses where source=0 and id%50=0)")
def j27(spark, sf):
    """Where the national source is present, the others of the same city are dropped."""
    a = tg.table(spark, sf, "addresses")
    have = a.where("source = 0 and id % 50 = 0").select("city").distinct().withColumn("have", F.lit(True))
    return a.join(have, "city", "left").where("source = 0 or have is null").select("id", "source")


@query("j30_alias_within_reach", tg.cte("places", "pois") + " select a.id as place, b.id as alias from places a join pois b on a.rank=16+b.id%10 where 2*6371000.0*asin(sqrt(least(1.0,power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lng-a.lng)/2),2))))<=200000")
def j30(spark, sf):
    rows = sp.within_radius(tg.table(spark, sf, "places").select(F.col("id").alias("qid"), "lat", "lng", F.col("rank").cast("long").alias("rank")), tg.table(spark, sf, "pois").select("id", "lat", "lng", (16 + F.col("id") % 10).alias("rank")), 4, 200_000, None, ("rank",))
    return rows.select(F.col("qid").alias("place"), F.col("id").alias("alias"))


@query("j31_alias_tokens", "select distinct a.p_partkey as query, b.s_suppkey as place from part a join supplier b on a.p_partkey%100=b.s_suppkey")
def j31(spark, sf):
    q = t(spark, sf, "part").select(F.col("p_partkey").alias("query"), F.concat(F.lit("Alias "), (F.col("p_partkey") % 100).cast("string")).alias("q"))
    alias = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("place"), F.concat(F.lit("alias-"), F.col("s_suppkey").cast("string")).alias("a"))
    return q.withColumn("k", tx.key(F.col("q"))).join(alias.withColumn("k", tx.key(F.col("a"))), "k").select("query", "place").distinct()


@query("j34_case_reports", "select o_orderkey as id, n, n=o_orderkey%7 as agrees from orders join (select l_orderkey k, count(*) n from lineitem group by 1) on k=o_orderkey")
def j34(spark, sf):
    r = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(r, "id").withColumn("agrees", F.col("n") == F.col("id") % 7)


COUNTIES = list(tx.BOROUGHS) + ["Erie County"]


@query("j35_boroughs", "select n_nationkey as id, case c " + " ".join(f"when '{k}' then '{v}'" for k, v in tx.BOROUGHS.items()) + f" end as borough from (select n_nationkey, list_extract({COUNTIES}, cast(n_nationkey%6+1 as bigint)) c from nation)")
def j35(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.get(F.array(*map(F.lit, COUNTIES)), (F.col("n_nationkey") % 6).cast("int")).alias("c"))
    table = spark.createDataFrame(list(tx.BOROUGHS.items()), "c string, borough string")
    return n.join(F.broadcast(table), "c", "left").select("id", "borough")


@query("j38_country_names", "select distinct lower(n_name) as name, n_nationkey as code from nation")
def j38(spark, sf):
    return t(spark, sf, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("code")).distinct()


@query("a04_largest_per_bucket", tg.cte("boxes", "polys") + ", b as (select *, floor((y0+y1)/2*2.5+0.5) by, floor((x0+x1)/2*2.5+0.5) bx from polys), r as (select *, row_number() over (partition by level, by, bx order by area desc, id) rn from b) select id, level from r where rn=1".replace(" by,", " b_y,").replace("level, by, bx", "level, b_y, bx"))
def a04(spark, sf):
    p = tg.polygons(spark, sf)
    c = geo.centroid(F.col("ring"))
    return rel.first_by(p.withColumn("b", geo.bucket(F.round(c["lat"], 6), F.round(c["lng"], 6), 2.5)), ["level", "b"], [F.col("area").desc(), F.col("id")]).select("id", "level")


@query("a06_posting_lists", tg.cte("pois") + " select cast(floor((lat+90)/4)*1048576+floor((lng+180)/4) as bigint) as cell, array_to_string(list(distinct id order by id), ',') as ids from pois group by 1")
def a06(spark, sf):
    p = tg.table(spark, sf, "pois").withColumn("cell", geo.cell(F.col("lat"), F.col("lng"), 4).cast("long"))
    g = p.groupBy("cell").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return g.select("cell", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("a08_first_samples", tg.cte("addresses") + ", r as (select *, row_number() over (partition by postcode, floor(lat), floor(lng) order by id) rn from addresses) select id, postcode from r where rn=1")
def a08(spark, sf):
    a = tg.table(spark, sf, "addresses").withColumn("y", F.floor("lat")).withColumn("x", F.floor("lng"))
    return rel.first_by(a, ["postcode", "y", "x"], [F.col("id")]).select("id", "postcode")


@query("a13_corpus_statistics", "select source, count(*) as n, round(avg(len(list_filter(regexp_split_to_array(text,'[^\\p{L}\\p{N}]+'), lambda w: w<>''))),4) as mean_length from documents group by 1")
def a13(spark, sf):
    d = t(spark, sf, "documents").select("source", F.size(tx.words(F.col("text"))).alias("dl"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("dl"), 4).alias("mean_length"))


@query("a15_build_counters", tg.cte("addresses") + " select source, count(*) as addresses, count(*) filter (unit is not null) as with_unit, count(distinct street) as streets from addresses group by 1")
def a15(spark, sf):
    return tg.table(spark, sf, "addresses").groupBy("source").agg(F.count("*").alias("addresses"), F.count_if(F.col("unit").isNotNull()).alias("with_unit"), F.count_distinct("street").alias("streets"))


@query("a22_kept_and_dropped", "select n_regionkey as country, case when c_acctbal<0 then 'debt' when c_mktsegment='BUILDING' then 'segment' else 'none' end as rule, count(*) as n from customer join nation on c_nationkey=n_nationkey group by 1,2")
def a22(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rule = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_mktsegment") == "BUILDING", "segment").otherwise("none")
    return c.groupBy(F.col("n_regionkey").alias("country"), rule.alias("rule")).agg(F.count("*").alias("n"))


@query("a28_area_km2", tg.cte("boxes", "polys") + " select id, round((y1-y0)*(x1-x0)*cos(radians((y0+y1)/2))*111.32*111.32,2) as km2 from polys")
def a28(spark, sf):
    return tg.polygons(spark, sf).select("id", F.round(geo.area_km2(F.col("ring")), 2).alias("km2"))


@query("a35_outcome_counts", "select count(*) filter (o_orderstatus='F') as passed, count(*) filter (o_orderstatus='O') as failed, count(*) filter (o_orderstatus='P') as partial from orders where contains(o_orderpriority,'H')")
def a35(spark, sf):
    s = F.col("o_orderstatus")
    return t(spark, sf, "orders").where(F.contains("o_orderpriority", F.lit("H"))).agg(F.count_if(s == "F").alias("passed"), F.count_if(s == "O").alias("failed"), F.count_if(s == "P").alias("partial"))


@query("w02_best_grade", "with g as (select p_partkey id, p_brand q, case when starts_with(p_name,'small') then 2 when contains(p_name,'ring') then 1 else 0 end grade from part), m as (select *, max(grade) over (partition by q) best from g) select id, grade from m where grade=best")
def w02(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("q"), F.when(F.startswith("p_name", F.lit("small")), 2).when(F.contains("p_name", F.lit("ring")), 1).otherwise(0).alias("grade"))
    best = p.groupBy("q").agg(F.max("grade").alias("best"))
    return p.join(best, "q").where("grade = best").select("id", "grade")


@query("w10_last_writer", "select l_partkey as id, max(l_orderkey) as last, min(l_orderkey) as first from lineitem group by 1")
def w10(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max_by("l_orderkey", "l_orderkey").alias("last"), F.min_by("l_orderkey", "l_orderkey").alias("first"))


@query("w11_burn_rates", "with m as (select date_trunc('hour', ts) h, count(*) n, count(*) filter (event_type='error') e from events group by 1) select h as hour, n, e as errors, sum(e) over (order by h range between interval 5 hours preceding and current row)*1.0/sum(n) over (order by h range between interval 5 hours preceding and current row) >= 0.25 as burning from m")
def w11(spark, sf):
    m = t(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    s = F.unix_seconds("h")
    m = m.withColumn("at", s).select("*", F.explode(F.array_distinct(F.array(F.floor(s / 86400), F.floor((s + 5 * 3600) / 86400)))).alias("day"))
    past = Window.partitionBy("day").orderBy("at").rangeBetween(-5 * 3600, 0)
    m = m.withColumn("burning", F.sum("errors").over(past) / F.sum("n").over(past) >= 0.25).where(F.floor(F.col("at") / 86400) == F.col("day"))
    return m.select(F.col("h").cast("timestamp_ntz").alias("hour"), "n", "errors", "burning")


@query("t05_rerank", "select o_orderkey as id, row_number() over (partition by o_custkey order by case when o_orderstatus='F' then 0 else 1 end, round(o_totalprice,0) desc, case when o_orderkey%4=0 then 1 else 0 end, o_orderkey) as pos from orders")
def t05(spark, sf):
    """Exact first, then the score, then without a unit, then the id."""
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") != "F").cast("int"), F.round("o_totalprice", 0).desc(), (F.col("o_orderkey") % 4 == 0).cast("int"), "o_orderkey")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("pos"))


@query("t07_place_order", tg.cte("places") + ", r as (select id, row_number() over (partition by id%7 order by case when rank=16 then 0 else 1 end, importance desc, id) pos from places) select id, pos from r where pos<=3")
def t07(spark, sf):
    p = tg.table(spark, sf, "places").withColumn("g", F.col("id") % 7)
    return se.top(p, ["g"], [(F.col("rank") != 16).cast("int"), F.desc("importance"), F.col("id")], 3).select("id", F.col("pos").cast("long").alias("pos"))


@query("t09_by_bias", tg.cte("places") + ", d as (select id, round(2*6371000.0*asin(sqrt(power(sin(radians(lat-10)/2),2)+cos(radians(10))*cos(radians(lat))*power(sin(radians(lng-20)/2),2))),2) m from places) select id, m as metres from d order by m, id limit 10")
def t09(spark, sf):
    p = tg.table(spark, sf, "places")
    m = F.round(geo.haversine(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lng")), 2)
    return p.select("id", m.alias("metres")).orderBy("metres", "id").limit(10)


@query("t12_sorted_names", "select distinct n_regionkey as entity, length(n_name) as kind, n_name as name from nation")
def t12(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_regionkey").alias("entity"), F.length("n_name").cast("long").alias("kind"), F.col("n_name").alias("name")).distinct().sort("entity", "kind", "name")


@query("t13_vertex_budget", "with r as (select l_orderkey k, l_linenumber i, l_quantity, sum(l_quantity) over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey rows unbounded preceding) used from lineitem) select k as id, count(*) as kept from r where used<=100 group by 1")
def t13(spark, sf):
    """Largest first while the running sum stays in the budget."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    r = t(spark, sf, "lineitem").withColumn("used", F.sum("l_quantity").over(w)).where("used <= 100")
    return r.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("kept"))


@query("t15_abstain", "select p_brand as brand, min(p_partkey) as id from part where p_size<3 group by 1 having count(distinct p_name)=1")
def t15(spark, sf):
    """An answer only where it is the only one."""
    g = t(spark, sf, "part").where("p_size < 3").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("p_name").alias("n"), F.min("p_partkey").alias("id"))
    return g.where("n = 1").select("brand", "id")


@query("u01_relaxed_if_empty", "select c_custkey as qid, o_orderkey as id, 'strict' as how from customer join orders on o_custkey=c_custkey where o_totalprice>150000 union all select c_custkey, o_orderkey, 'relaxed' from customer join orders on o_custkey=c_custkey where c_custkey not in (select o_custkey from orders where o_totalprice>150000)")
def u01(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "o_totalprice").join(t(spark, sf, "customer").select(F.col("c_custkey").alias("qid")), "qid")
    strict = o.where("o_totalprice > 150000")
    return strict.select("qid", "id", F.lit("strict").alias("how")).unionByName(o.join(strict.select("qid").distinct(), "qid", "left_anti").select("qid", "id", F.lit("relaxed").alias("how")))


@query("u02_two_readings", "select p_partkey as id, 'type' as reading from part where p_type='TYPE_1' union select p_partkey, 'brand' from part where p_brand='Brand#1'")
def u02(spark, sf):
    p = t(spark, sf, "part")
    a = p.where("p_type = 'TYPE_1'").select(F.col("p_partkey").alias("id"), F.lit("type").alias("reading"))
    return a.unionByName(p.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("id"), F.lit("brand").alias("reading"))).distinct()


@query("u03_countries", "select c_nationkey as country from customer union select s_nationkey from supplier")
def u03(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("country")).unionByName(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("country"))).distinct()


@query("u06_token_sets", "select p_partkey as id, len(list_intersect(string_split(p_name,' '), ['small','ring'])) as shared from part")
def u06(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(F.array_intersect(F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring")))).cast("long").alias("shared"))


@query("u09_merged_cases", "with u as (select concat('a/', p_name) id, p_brand v, p_partkey k from part where p_partkey%2=0 union all select concat('a/', p_name), p_type, p_partkey from part where p_partkey%2=1), r as (select *, row_number() over (partition by id order by k) rn from u) select id, v from r where rn=1")
def u09(spark, sf):
    p = t(spark, sf, "part")
    a = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("a/"), "p_name").alias("id"), F.col("p_brand").alias("v"), F.col("p_partkey").alias("k"))
    b = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("a/"), "p_name").alias("id"), F.col("p_type").alias("v"), F.col("p_partkey").alias("k"))
    return rel.first_by(a.unionByName(b), ["id"], [F.col("k")]).select("id", "v")


@query("r18_space_candidates", "select p_partkey as id, cast(length(replace(p_name,' ','')) as bigint) as n from part")
def r18(spark, sf):
    """One join of the two words and every single split of it: as many as the letters."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), se.split_join_candidates(F.array(F.replace("p_name", F.lit(" "), F.lit("")))).alias("c"))
    return p.select("id", (F.size("c") + 1).cast("long").alias("n"))


@query("r30_validate", tg.cte("addresses") + ", q as (select id qid, street, housenumber, postcode from addresses), w as (select street, housenumber, postcode, count(*) full_n from addresses group by all), s as (select street, count(*) street_n from addresses group by all), m as (select qid, full_n, street_n from q left join w using (street, housenumber, postcode) left join s using (street)) select qid, case when full_n>=1 then 'verified' when street_n>0 then 'partial' else 'unverified' end as verdict from m")
def r30(spark, sf):
    a = tg.table(spark, sf, "addresses").select("street", "housenumber", "postcode", "id")
    q = a.select(F.col("id").alias("qid"), "street", F.col("housenumber").alias("qh"), F.col("postcode").alias("qp"))
    whole = a.groupBy("street", "housenumber", "postcode").agg(F.count("*").alias("full_n"))
    some = a.groupBy("street").agg(F.count("*").alias("street_n"))
    m = q.join(whole, (q["street"] == whole["street"]) & (q["qh"] == whole["housenumber"]) & (q["qp"] == whole["postcode"]), "left").select("qid", q["street"], "full_n").join(some, "street", "left")
    return m.select("qid", F.when(F.coalesce("full_n", F.lit(0)) >= 1, "verified").when(F.coalesce("street_n", F.lit(0)) > 0, "partial").otherwise("unverified").alias("verdict"))


@query("r32_seeded_sample", tg.cte("addresses") + " select id from addresses order by md5(concat('7:', cast(id as varchar))), id limit 100")
def r32(spark, sf):
    return tg.table(spark, sf, "addresses").orderBy(F.md5(F.concat(F.lit("7:"), F.col("id").cast("string")).cast("binary")), "id").limit(100).select("id")


@query("r34_query_variants", tg.cte("addresses") + ", b as (select id, concat(housenumber,' ',street) q from addresses) select id, 'freeform' as variant, q from b union all select id, 'abbreviation', replace(q,'Street','St') from b union all select id, 'typo', concat(left(q,3), substring(q,5,1), substring(q,4,1), substring(q,6)) from b")
def r34(spark, sf):
    b = tg.table(spark, sf, "addresses").select("id", F.concat_ws(" ", "housenumber", "street").alias("q"))
    s = lambda a, n=None: F.substr("q", F.lit(a), F.lit(n)) if n else F.substr("q", F.lit(a))
    v = {"freeform": F.col("q"), "abbreviation": F.replace("q", F.lit("Street"), F.lit("St")), "typo": F.concat(s(1, 3), s(5, 1), s(4, 1), s(6))}
    return b.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("q")) for k, c in v.items()])))


@query("sk13_json_rows", "select p_partkey as id, to_json({'name': p_name, 'size': p_size}) as body from part")
def sk13(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("body"))


@query("sk04_merged_cells", tg.cte("places", "pois", "coords") + ", c as (select cast(floor((lat+90)/8)*1048576+floor((lng+180)/8) as bigint) cell, 'place' k from places union all select cast(floor((lat+90)/8)*1048576+floor((lng+180)/8) as bigint), 'poi' from pois) select cell, count(*) filter (k='place') as places, count(*) filter (k='poi') as pois from c group by 1")
def sk04(spark, sf):
    c = lambda n: tg.table(spark, sf, n).groupBy(geo.cell(F.col("lat"), F.col("lng"), 8).cast("long").alias("cell")).agg(F.count("*").alias(n))
    m = c("places").join(c("pois"), "cell", "full_outer")
    return m.select("cell", F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("pois", F.lit(0)).alias("pois"))
