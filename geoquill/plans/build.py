"""Build and ranking steps over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoquill.functions import geo
from geoquill.functions import text as tx
from geoquill.operators import relational as rel
from geoquill.operators import search as se

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


@query("f01_included_ways", "select p_partkey as id, p_type from part where p_type not in ('TYPE_1','TYPE_3') and p_name is not null")
def f01(spark, sf):
    return t(spark, sf, "part").where(~F.col("p_type").isin("TYPE_1", "TYPE_3") & F.col("p_name").isNotNull()).select(F.col("p_partkey").alias("id"), "p_type")


#: Place kinds and their ranks.
PLACE_RANKS = {"city": 16, "town": 16, "village": 16, "island": 17, "suburb": 19, "hamlet": 20, "locality": 21, "islet": 21, "neighbourhood": 22, "quarter": 22, "isolated_dwelling": 25, "farm": 25}
KINDS = [*PLACE_RANKS, "sea", "plot"]


@query("f02_place_rank", f"select s_suppkey as id, kind, case kind {' '.join(f'when {chr(39)}{k}{chr(39)} then {v}' for k, v in PLACE_RANKS.items())} end as rank from (select s_suppkey, list_extract({KINDS}, cast(s_suppkey%{len(KINDS)}+1 as bigint)) kind from supplier) where kind not in ('sea','plot')")
def f02(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.get(F.array(*map(F.lit, KINDS)), (F.col("s_suppkey") % len(KINDS)).cast("int")).alias("kind"))
    return s.withColumn("rank", F.try_element_at(tx.mapping(PLACE_RANKS), F.col("kind"))).where("rank is not null")


#: Keys that make a point of interest, first match wins, and railway values that do not.
POI_KEYS = "amenity shop tourism aeroway historic leisure office healthcare military man_made railway".split()
NO_POI_RAILWAY = "rail tram subway light_rail narrow_gauge monorail preserved construction abandoned razed disused razed_rail yard".split()
NATURAL_POI = "peak water bay cape volcano glacier cave_entrance spring".split()
WATERWAY_POI = "waterfall dock canal_lock".split()


def poi_category(tags):
    """key:value of the first key in order that a tag map has, or null."""
    got = lambda k: F.nullif(F.try_element_at(tags, F.lit(k)), F.lit(""))
    first = [F.when(~got(k).isin(NO_POI_RAILWAY) if k == "railway" else got(k).isNotNull(), F.concat(F.lit(k + ":"), got(k))) for k in POI_KEYS]
    nature = [F.when(got(k).isin(v), F.concat(F.lit(k + ":"), got(k))) for k, v in (("natural", NATURAL_POI), ("waterway", WATERWAY_POI))]
    return F.coalesce(*first, *nature)


@query("f03_poi_category", "select p_partkey as id, case when p_partkey%5=0 then concat('shop:',p_brand) when p_partkey%4=0 then null when p_partkey%3=0 then 'natural:peak' when p_partkey%2=0 then 'railway:station' end as category, case when p_partkey%7=0 then 10 else 15 end as rank from part where p_partkey%5=0 or (p_partkey%4<>0 and (p_partkey%3=0 or p_partkey%2=0))")
def f03(spark, sf):
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    tags = F.map_filter(
        F.create_map(F.lit("shop"), F.when(k % 5 == 0, F.col("p_brand")), F.lit("railway"), F.when(k % 4 == 0, "tram").when((k % 2 == 0) & (k % 3 != 0), "station"), F.lit("natural"), F.when((k % 3 == 0) & (k % 4 != 0), "peak")),
        lambda _, v: v.isNotNull(),
    )
    return p.select(k.alias("id"), poi_category(tags).alias("category"), F.when(k % 7 == 0, 10).otherwise(15).alias("rank")).where("category is not null")


@query("f05_address_ladder", "select o_orderkey as id, coalesce(case when o_orderkey%3=0 then o_orderpriority end, case when o_orderkey%2=0 then o_orderstatus end, 'none') as street from orders where o_orderkey%7<>0")
def f05(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").where(k % 7 != 0).select(k.alias("id"), F.coalesce(F.when(k % 3 == 0, F.col("o_orderpriority")), F.when(k % 2 == 0, F.col("o_orderstatus")), F.lit("none")).alias("street"))


@query("f09_numeric_rows", "select cast(count(*) as bigint) as kept, cast(sum(case when try_cast(x as double) is null then 1 else 0 end) as bigint) as dropped from (select case when l_linenumber=1 then 'bad' else cast(l_quantity as varchar) end x from lineitem)")
def f09(spark, sf):
    x = F.when(F.col("l_linenumber") == 1, "bad").otherwise(F.col("l_quantity").cast("string"))
    return t(spark, sf, "lineitem").agg(F.count("*").alias("kept"), F.count_if(x.try_cast("double").isNull()).alias("dropped"))


@query("f25_valid_coords", tg.cte("coords") + " select qid, case when lat not between -59 and 59 then 'latitude' when lng not between -169 and 169 then 'longitude' end as error from coords")
def f25(spark, sf):
    """Rows out of range keep an error, they are not lost."""
    return tg.table(spark, sf, "coords").select("qid", F.when(~F.col("lat").between(-59, 59), "latitude").when(~F.col("lng").between(-169, 169), "longitude").alias("error"))


@query("f26_resolution_lists", "select c_custkey as id, list_filter(list_distinct([c_custkey%17, c_custkey%19, 3]), lambda r: r between 0 and 15) is not null as ok, len(list_filter(list_distinct([c_custkey%17, c_custkey%19, 3]), lambda r: r between 0 and 15)) <= 4 as few from customer")
def f26(spark, sf):
    k = F.col("c_custkey")
    lst = F.filter(F.array_distinct(F.transform(F.split(F.concat_ws(",", (k % 17).cast("string"), (k % 19).cast("string"), F.lit("3")), ","), lambda x: x.try_cast("int"))), lambda r: r.between(0, 15))
    return t(spark, sf, "customer").select(k.alias("id"), lst.isNotNull().alias("ok"), (F.size(lst) <= 4).alias("few"))


@query("j16_star_join", "select l_orderkey as id, l_linenumber as line, p_name, s_name, n_name from lineitem join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey")
def j16(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    rows = li.join(t(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "p_name", "s_name", "n_name")


@query("a03_modal_postcode", tg.cte("addresses") + ", n as (select city, postcode, count(*) c from addresses group by 1,2), r as (select *, row_number() over (partition by city order by c desc, postcode) rn from n) select city, postcode, c as n from r where rn=1")
def a03(spark, sf):
    return rel.mode(tg.table(spark, sf, "addresses"), ["city"], "postcode")


@query("j18_postcode_lookup", tg.cte("addresses") + ", n as (select city, postcode, count(*) c from addresses group by 1,2), r as (select *, row_number() over (partition by city order by c desc, postcode) rn from n), m as (select city, postcode from r where rn=1) select a.id, coalesce(case when a.id%3=0 then a.postcode end, m.postcode) as postcode from addresses a left join m using (city)")
def j18(spark, sf):
    a = tg.table(spark, sf, "addresses")
    m = rel.mode(a, ["city"], "postcode").select(F.col("city"), F.col("postcode").alias("usual"))
    return a.join(m, "city", "left").select("id", F.coalesce(F.when(F.col("id") % 3 == 0, F.col("postcode")), F.col("usual")).alias("postcode"))


@query("j20_first_association", "select o_orderkey as id, m.part from orders left join (select l_orderkey, min(l_partkey) filter (l_linenumber=1) part from lineitem group by 1) m on o_orderkey=l_orderkey")
def j20(spark, sf):
    first = t(spark, sf, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
    return t(spark, sf, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), "part")


@query("j21_way_nodes", "select l_orderkey as way, array_to_string(list(p_name order by l_linenumber, p_name), '|') as nodes from lineitem join part on l_partkey=p_partkey group by 1")
def j21(spark, sf):
    """Way members with their nodes' attributes, in member order."""
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "p_name").alias("m"))
    lists = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return lists.select(F.col("l_orderkey").alias("way"), F.array_join("m.p_name", "|").alias("nodes"))


@query("j22_members_without_relation", "select o_orderkey as id from orders o where not exists (select 1 from orders r where r.o_orderkey%10=0 and r.o_custkey=o.o_custkey and r.o_orderpriority=o.o_orderpriority)")
def j22(spark, sf):
    o = t(spark, sf, "orders")
    r = o.where("o_orderkey % 10 = 0").select("o_custkey", "o_orderpriority").distinct()
    return o.join(r, ["o_custkey", "o_orderpriority"], "left_anti").select(F.col("o_orderkey").alias("id"))


@query("j24_new_signatures", tg.cte("places", "pois") + " select p.id from pois p where not exists (select 1 from places s where floor(s.lat*0.1+0.5)=floor(p.lat*0.1+0.5) and floor(s.lng*0.1+0.5)=floor(p.lng*0.1+0.5))")
def j24(spark, sf):
    sig = geo.bucket(F.col("lat"), F.col("lng"), 0.1).alias("sig")
    return tg.table(spark, sf, "pois").select("id", sig).join(tg.table(spark, sf, "places").select(sig).distinct(), "sig", "left_anti").select("id")


@query("j26_misplaced_twins", tg.cte("places") + ", d as (select a.id, round(2*6371.0*asin(sqrt(power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lng-a.lng)/2),2))),3) km from places a join places b on a.rank=b.rank and a.id>b.id) select id from places where id not in (select id from d where km < 2500)")
def j26(spark, sf):
    """Places without an earlier one of the same rank nearby; twins meet on rank and coarse cells."""
    p = tg.table(spark, sf, "places").select("id", "lat", "lng", "rank")
    from geoquill.operators.spatial import within_radius

    near = within_radius(p.withColumnRenamed("id", "qid"), p, 15, 2_500_000, None, ("rank",))
    twins = near.where((F.col("qid") > F.col("id")) & (F.round(F.col("metres") / 1000, 3) < 2500)).select(F.col("qid").alias("id")).distinct()
    return p.join(twins, "id", "left_anti").select("id")


@query("j28_missing_postcodes", tg.cte("addresses") + " select postcode, min(id) as id, 'map' as origin from addresses where id%2=0 group by 1 union all select postcode, min(id), 'gazetteer' from addresses where id%2=1 and postcode not in (select postcode from addresses where id%2=0) group by 1")
def j28(spark, sf):
    a = tg.table(spark, sf, "addresses")
    own = a.where("id % 2 = 0").groupBy("postcode").agg(F.min("id").alias("id")).withColumn("origin", F.lit("map"))
    more = a.where("id % 2 = 1").groupBy("postcode").agg(F.min("id").alias("id")).withColumn("origin", F.lit("gazetteer"))
    return own.unionByName(more.join(own, "postcode", "left_anti"))


@query("j29_countries_with_postcode", tg.cte("addresses") + " select distinct source from addresses where postcode in (select postcode from addresses where city='Town 3')")
def j29(spark, sf):
    a = tg.table(spark, sf, "addresses")
    return a.join(a.where("city = 'Town 3'").select("postcode").distinct(), "postcode", "left_semi").select("source").distinct()


@query("j33_prior_country", "select c_custkey as id, coalesce(case when c_custkey%4<>0 then n.n_name end, r.r_name) as country from customer join nation n on c_nationkey=n_nationkey join region r on n_regionkey=r_regionkey")
def j33(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), F.coalesce(F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")), F.col("r_name")).alias("country"))


@query("j37_set_difference", "select p_brand as v, 'left' as side from (select distinct p_brand from part where p_partkey%211=0 except select distinct p_brand from part where p_partkey%303=0) union all select p_brand, 'right' from (select distinct p_brand from part where p_partkey%303=0 except select distinct p_brand from part where p_partkey%211=0)")
def j37(spark, sf):
    p = t(spark, sf, "part")
    return rel.sides_differ(p.where("p_partkey % 211 = 0").select(F.col("p_brand").alias("v")).distinct(), p.where("p_partkey % 303 = 0").select(F.col("p_brand").alias("v")).distinct())


@query("a05_distinct_streets", tg.cte("addresses") + ", r as (select *, row_number() over (partition by street, city order by id) rn from addresses) select street, city, id from r where rn=1")
def a05(spark, sf):
    return rel.first_by(tg.table(spark, sf, "addresses"), ["street", "city"], [F.col("id")]).select("street", "city", "id")


@query("a07_postcode_representative", tg.cte("addresses") + ", r as (select *, row_number() over (partition by postcode order by lat, lng, id) rn from addresses) select postcode, id, round(lat,6) lat, round(lng,6) lng from r where rn=1")
def a07(spark, sf):
    m = tg.table(spark, sf, "addresses").groupBy("postcode").agg(F.min(F.struct("lat", "lng", "id")).alias("m"))
    return m.select("postcode", "m.id", F.round("m.lat", 6).alias("lat"), F.round("m.lng", 6).alias("lng"))


@query("a11_document_frequency", "select term, count(distinct doc_id) as df from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text),'[^\\p{L}\\p{N}]+'), lambda w: w<>'')) term from documents) group by 1 having count(distinct doc_id) >= 50")
def a11(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df")).where("df >= 50")


BM = """with d as (select doc_id, source, list_filter(regexp_split_to_array(lower(replace(translate(text,'%s','%s'),'ß','ss')),'[^\\p{L}\\p{N}]+'), lambda w: w<>'') w from documents),
 p as (select source, doc_id, term, count(*) tf, any_value(dl) dl from (select source, doc_id, unnest(w) term, len(w) dl from d) group by 1,2,3),
 st as (select source, count(*) n, avg(dl) a from (select source, doc_id, any_value(dl) dl from p group by 1,2) group by 1), df as (select source, term, count(*) df from p group by 1,2),
 q as (select qid, term from (values (1,'the'),(1,'thing'),(2,'les'),(2,'eaux'),(3,'que'),(3,'para')) v(qid,term))
 select qid, source, doc_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/a))),4) score, count(*) hit_terms from p join q using (term) join st using (source) join df using (source, term) group by 1,2,3""" % (tx.ACCENTED, tx.PLAIN)  # fmt: skip


def _bm(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "text")
    q = spark.createDataFrame([(1, "the"), (1, "thing"), (2, "les"), (2, "eaux"), (3, "que"), (3, "para")], "qid int, term string")
    hits = se.bm25(se.postings(d, ["text"], ["source"], q), se.field_lengths(d, ["text"], ["source"]), q, ["source"])
    return hits.withColumn("score", F.round("score", 4)), q


@query("a14_bm25", BM)
def a14(spark, sf):
    return _bm(spark, sf)[0]


@query("t06_merged_top", f"with hits as ({BM}), need as (select * from hits where hit_terms=2), r as (select *, row_number() over (partition by qid order by score desc, source, doc_id) pos from need) select qid, source, doc_id, score, cast(pos as bigint) pos from r where pos<=10")
def t06(spark, sf):
    """Top ten per query across shards, all terms required; statistics stay the shard's own."""
    hits, q = _bm(spark, sf)
    out = se.top(se.all_terms(hits, q), ["qid"], [F.col("score").desc(), F.col("source"), F.col("doc_id")], 10)
    return out.select("qid", "source", "doc_id", "score", F.col("pos").cast("long").alias("pos"))


@query("r13_rank_unbiased", "select s_suppkey as id, round(10*greatest(1.0,least(2.0,1+greatest(0.0,(26-r)/10)*0.4))+i/255*1.5,4) as score from (select s_suppkey, cast(greatest(16+s_suppkey%10, case when s_suppkey%2=0 then 20 else 0 end) as double) r, cast(s_suppkey*37%256 as double) i from supplier)")
def r13(spark, sf):
    p = tg.table(spark, sf, "places")
    return p.select("id", F.round(se.prominence(F.lit(10.0), F.col("rank"), F.col("importance"), F.col("id") % 2 == 0), 4).alias("score"))


@query("r14_rank_biased", "select s_suppkey as id, round(10*(case when s_suppkey%2=0 and km<50 then 1+(1-km/50)*(i/255)*0.5 else 1.0 end)+i/255*4-0.2*ln(km+1)-greatest(0.0,km-500)/1000,4) as score from (select s_suppkey, cast(s_suppkey*13%900 as double) km, cast(s_suppkey*37%256 as double) i from supplier)")
def r14(spark, sf):
    p, km = tg.table(spark, sf, "places"), (F.col("id") * 13 % 900).cast("double")
    return p.select("id", F.round(se.biased(F.lit(10.0), F.col("importance"), km, F.col("id") % 2 == 0), 4).alias("score"))


ENTRIES = """e as (select country, key, id, name, rank from (select *, row_number() over (partition by country, key order by rank, id) rn from (select cast(p_partkey%5 as int) country, p_partkey as id, concat('The ', p_name) as name, unnest(['the ' || lower(p_name), lower(p_name)]) as key, cast(p_size as int) rank from part)) where rn=1)"""


def _entries(spark, sf):
    names = t(spark, sf, "part").select((F.col("p_partkey") % 5).cast("int").alias("country"), F.col("p_partkey").alias("id"), F.concat(F.lit("The "), F.col("p_name")).alias("name"), F.col("p_size").alias("rank"))
    return se.autocomplete_entries(names)


@query("a09_key_collisions", f"with {ENTRIES} select country, key, id, cast(rank as int) rank from e")
def a09(spark, sf):
    return _entries(spark, sf).select("country", "key", "id", "rank")


@query("r25_prefix_search", f"with {ENTRIES}, q as (select c_custkey as qid, cast(c_custkey%5 as int) country, left(case when c_custkey%7=0 then 'the ' || lower(p_name) else lower(p_name) end, cast(1 + c_custkey%9 as int)) prefix from customer join part on p_partkey=c_custkey%100+1), w as (select q.qid, e.id, e.rank, e.name, row_number() over (partition by q.qid order by e.key) step from q join e on q.country=e.country and starts_with(e.key, q.prefix)), r as (select *, row_number() over (partition by qid order by rank, id) k from w where step<=40) select qid, id, row_number() over (partition by qid order by rank, name, id) pos from r where k<=5")
def r25(spark, sf):
    e = _entries(spark, sf)
    c = t(spark, sf, "customer").join(t(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey") % 100 + 1)
    q = c.select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 5).cast("int").alias("country"), F.left(F.concat(F.when(F.col("c_custkey") % 7 == 0, "the ").otherwise(""), F.lower("p_name")), (1 + F.col("c_custkey") % 9).cast("int")).alias("prefix"))
    return se.prefix_search(e, q, 5, walk=40).select("qid", "id", F.col("pos").cast("long").alias("pos"))


@query("r24_exact_search", f"with {ENTRIES}, q as (select c_custkey as qid, cast(c_custkey%5 as int) country, lower(p_name) k from customer join part on p_partkey=c_custkey%100+1) select qid, id from q join e on q.country=e.country and q.k=e.key")
def r24(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey") % 100 + 1)
    q = c.select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 5).cast("int").alias("country"), F.upper("p_name").alias("q"))
    return se.exact_search(_entries(spark, sf).select("country", "key", "id"), q).select("qid", "id")


@query("r16_ladder", "with r0 as (select o_orderkey as qid, 0 as rung from orders where o_totalprice > 200000), r1 as (select o_orderkey, 1 from orders where o_orderkey not in (select qid from r0) and o_orderstatus='F'), r2 as (select o_orderkey, 2 from orders where o_totalprice<=200000 and o_orderstatus<>'F' and o_orderpriority like '1%') select * from r0 union all select * from r1 union all select * from r2")
def r16(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    rungs = [lambda d: d.where("o_totalprice > 200000"), lambda d: d.where("o_orderstatus = 'F'"), lambda d: d.where("o_orderpriority like '1%'")]
    return rel.first_non_empty(rungs, o, "qid").select("qid", "rung")


@query("a21_grouping_sets", "select c_mktsegment as variant, cast(c_nationkey%3 as int) as stratum, count(*) as n, round(avg(c_acctbal),2) as mean from customer group by grouping sets ((), (variant), (stratum), (variant, stratum))")
def a21(spark, sf):
    cases = t(spark, sf, "customer").selectExpr("c_mktsegment variant", "cast(c_nationkey % 3 as int) stratum", "c_acctbal")
    return spark.sql("select variant, stratum, count(*) n, round(avg(c_acctbal), 2) mean from {cases} group by grouping sets ((), (variant), (stratum), (variant, stratum))", cases=cases)


#: Upper bounds of the latency histogram, seconds, and of the distance histogram, metres.
DURATIONS = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
DISTANCES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 10000.0]


@query("a17_histogram", "select event_type as endpoint, b as le, count(*) filter (value/100 <= b) as n from events, (select unnest(%s) b) group by 1,2" % DURATIONS)
def a17(spark, sf):
    """Cumulative buckets: one pass, one column a bucket, then unpivoted."""
    e = t(spark, sf, "events").groupBy(F.col("event_type").alias("endpoint")).agg(*[F.count_if(F.col("value") / 100 <= b).alias(f"b{k}") for k, b in enumerate(DURATIONS)])
    return e.select("endpoint", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(DURATIONS)])))


@query("a18_unpivot_axes", "select axis, outcome, count(*) as n from (select 'country' axis, case when user_id%2=0 then 'match' else 'mismatch' end outcome from events union all select 'city', case when user_id%3=0 then 'match' when user_id%3=1 then 'none' else 'mismatch' end from events) group by 1,2")
def a18(spark, sf):
    u = F.col("user_id")
    e = t(spark, sf, "events").select(F.when(u % 2 == 0, "match").otherwise("mismatch").alias("country"), F.when(u % 3 == 0, "match").when(u % 3 == 1, "none").otherwise("mismatch").alias("city"))
    return e.unpivot([], ["country", "city"], "axis", "outcome").groupBy("axis", "outcome").agg(F.count("*").alias("n"))


@query("a19_rates", "select event_type as endpoint, time_bucket(interval 5 minutes, ts) as start, count(*) as n, count(*)/300.0::double as per_second from events group by 1,2")
def a19(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("event_type").alias("endpoint"), F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("endpoint", F.col("w.start").alias("start"), "n", (F.col("n") / 300.0).alias("per_second"))


@query("a20_pass_rate", "select c_mktsegment as scenario, c_nationkey as country, count(*) as total, count(*) filter (c_acctbal>0) as passed, round(count(*) filter (c_acctbal>0)*1.0/count(*),4) as rate from customer group by 1,2")
def a20(spark, sf):
    c = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("scenario"), F.col("c_nationkey").alias("country"))
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("passed"), F.round(F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 4).alias("rate"))


@query("a23_dominance", "with r as (select n_regionkey as g, c_custkey as id, round(c_acctbal,2) pop, row_number() over (partition by n_regionkey order by c_acctbal desc, c_custkey) rn, lead(round(c_acctbal,2)) over (partition by n_regionkey order by c_acctbal desc, c_custkey) runner_up from customer join nation on c_nationkey=n_nationkey) select g, id, pop, runner_up, pop >= 1.001*runner_up as dominant from r where rn=1")
def a23(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    rows = c.select(F.col("n_regionkey").alias("g"), F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("pop"), F.row_number().over(w).alias("rn"), F.lead(F.round("c_acctbal", 2)).over(w).alias("runner_up"))
    return rows.where("rn = 1").select("g", "id", "pop", "runner_up", (F.col("pop") >= 1.001 * F.col("runner_up")).alias("dominant"))


@query("a31_inspection", tg.cte("addresses") + " select street, array_to_string(list(distinct city order by city), ',') as cities, count(*) as n from addresses group by 1 having count(distinct city) >= 3")
def a31(spark, sf):
    g = tg.table(spark, sf, "addresses").groupBy("street").agg(F.sort_array(F.collect_set("city")).alias("c"), F.count("*").alias("n")).where("size(c) >= 3")
    return g.select("street", F.array_join("c", ",").alias("cities"), "n")


@query("u04_row_counts", " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in ("orders", "customer", "supplier", "part")))
def u04(spark, sf):
    out = None
    for n in ("orders", "customer", "supplier", "part"):
        one = t(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("u05_distinct_identities", tg.cte("addresses") + ", r as (select *, row_number() over (partition by street, housenumber, postcode order by id) rn from addresses where unit is null) select id from r where rn=1")
def u05(spark, sf):
    return rel.first_by(tg.table(spark, sf, "addresses").where("unit is null"), ["street", "housenumber", "postcode"], [F.col("id")]).select("id")


@query("w05_first_failures", "with r as (select c_custkey as id, c_nationkey as country, row_number() over (partition by c_nationkey order by c_custkey) a from customer where c_acctbal<0), s as (select *, row_number() over (order by id) b from r where a<=3) select id, country from s where b<=20")
def w05(spark, sf):
    bad = t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country"))
    return se.top(bad, ["country"], [F.col("id")], 3).drop("pos").orderBy("id").limit(20)


@query("w06_top_by_population", "with r as (select c_custkey as id, c_nationkey as country, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) pos from customer) select id, country, cast(pos as bigint) pos from r where pos<=10")
def w06(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country"), "c_acctbal")
    return se.top(c, ["country"], [F.desc("c_acctbal"), F.col("id")], 10).select("id", "country", F.col("pos").cast("long").alias("pos"))


@query("w08_stratified_quota", tg.cte("addresses") + ", s as (select id, case when unit is not null then 'unit' when housenumber like '%-%' then 'range' when regexp_matches(housenumber,'[A-Za-z]') then 'suffix' else 'plain' end stratum from addresses), r as (select *, row_number() over (partition by stratum order by id) k from s), f as (select *, case when stratum<>'plain' and k<=10 then 0 else case stratum when 'plain' then 1 when 'unit' then 2 when 'suffix' then 3 else 4 end end tier from r), g as (select *, row_number() over (order by tier, id) pos from f) select id, stratum from g where pos<=100")
def w08(spark, sf):
    """Up to a tenth each of units, suffixes and ranges, then plain and the rest in that order until the sample is full."""
    s = tg.table(spark, sf, "addresses").select("id", tx.stratum(F.col("housenumber"), F.col("unit")).alias("stratum"))
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("id")))
    order = tx.mapping({"plain": 1, "unit": 2, "suffix": 3, "range": 4})
    tier = F.when((F.col("stratum") != "plain") & (F.col("k") <= 10), 0).otherwise(F.try_element_at(order, F.col("stratum")))
    return s.withColumn("tier", tier).orderBy("tier", "id").limit(100).select("id", "stratum")


@query("w09_traffic_drop", "with w as (select time_bucket(interval 5 minutes, ts) s, count(*) n from events group by 1), a as (select s, n, avg(n) over (order by s range between interval 1 hour preceding and interval 5 minutes preceding) m from w) select s as start, n, round(m,4) as mean, n < 0.5*m as dropped from a")
def w09(spark, sf):
    """Each five minutes against the mean of the hour before; counts are partitioned by day with the hour before it."""
    w = t(spark, sf, "events").groupBy(F.window("ts", "5 minutes")["start"].alias("start")).agg(F.count("*").alias("n"))
    s = F.unix_seconds(F.col("start").cast("timestamp"))
    w = w.withColumn("at", s).select("*", F.explode(F.array_distinct(F.array(F.floor(s / 86400), F.floor((s + 3600) / 86400)))).alias("day"))
    past = Window.partitionBy("day").orderBy("at").rangeBetween(-3600, -300)
    w = w.withColumn("m", F.avg("n").over(past)).where(F.floor(F.col("at") / 86400) == F.col("day"))
    return w.select("start", "n", F.round("m", 4).alias("mean"), (F.col("n") < 0.5 * F.col("m")).alias("dropped"))


@query("st06_daily_cap", "with r as (select event_id, ts, row_number() over (partition by date_trunc('day', ts) order by ts, event_id) k from events) select event_id, k <= 100 as sent from r")
def st06(spark, sf):
    k = F.row_number().over(Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id"))
    return t(spark, sf, "events").select("event_id", (k <= 100).alias("sent"))


@query("st07_sticky_disable", "select event_id, ts < (select min(ts) from events where event_type='error' and value > 90) as active from events")
def st07(spark, sf):
    e = t(spark, sf, "events")
    stop = e.where("event_type = 'error' and value > 90").agg(F.min("ts").alias("stop"))
    return e.join(F.broadcast(stop)).select("event_id", (F.col("ts") < F.col("stop")).alias("active"))


@query("st08_outcomes", "select event_id, case when event_type='error' then 'failed' when value is null then 'no_result' when value > 80 then 'mismatch' else 'match' end as outcome from events")
def st08(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").when(v.isNull(), "no_result").when(v > 80, "mismatch").otherwise("match").alias("outcome"))


@query("d1_next_midnight", "select event_id, date_trunc('day', ts) + interval 1 day as midnight from events")
def d1(spark, sf):
    return t(spark, sf, "events").select("event_id", F.expr("cast(date_trunc('day', ts) as timestamp_ntz) + interval 1 day").alias("midnight"))


@query("sc28_catalog", "select n_regionkey as part, count(*) as countries, min(n_name) as first from nation group by 1")
def sc28(spark, sf):
    return t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("part")).agg(F.count("*").alias("countries"), F.min("n_name").alias("first"))
