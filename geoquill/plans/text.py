"""Text functions over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.functions import text as tx

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


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(c: str) -> str:
    return f"replace(translate({c}, '{tx.ACCENTED}', '{tx.PLAIN}'), 'ß', 'ss')"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def case_sql(c: str, pairs: dict, other: str) -> str:
    return f"case {c} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in pairs.items()) + f" else {other} end"


WHOLE = "select doc_id, text as t from documents"
SHORT = {"saint": "st", "sainte": "st", "st": "st", "ste": "st", "mount": "mt", "mt": "mt", "fort": "ft", "ft": "ft"}


@query("x01_fold", f"select doc_id, {fold_sql('t')} as folded, length({fold_sql('t')}) as n from ({WHOLE})")
def x01(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.fold(F.col("text")).alias("folded"))
    return d.select("*", F.length("folded").cast("long").alias("n"))


@query("x02_key", f"select doc_id, array_to_string(list_transform(w, lambda x, i: case when i < len(w) then {case_sql('x', SHORT, 'x')} else x end), ' ') as key from (select doc_id, {words_sql(f'lower({fold_sql(chr(116))})')} w from ({WHOLE}))")
def x02(spark, sf):
    return docs(spark, sf).select("doc_id", tx.key(F.col("text")).alias("key"))


@query("x19_locality", f"select doc_id, array_to_string({words_sql(f'lower({fold_sql(chr(116))})')}, ' ') as locality from ({WHOLE})")
def x19(spark, sf):
    return docs(spark, sf).select("doc_id", tx.locality(F.col("text")).alias("locality"))


STREETS = "select p_partkey as id, concat(split_part(p_name,' ',1), ' ', list_extract(['St','Ave','Rd','Blvd','Hwy','Ct','Jr Blvd','St SE','St N','Lane'], cast(p_partkey % 10 + 1 as bigint))) as s from part"


def street_names(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("St", "Ave", "Rd", "Blvd", "Hwy", "Ct", "Jr Blvd", "St SE", "St N", "Lane")])
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.get(kinds, (F.col("p_partkey") % 10).cast("int"))).alias("s"))


@query("x07_street_types", f"select id, array_to_string(list_transform(w, lambda x, i: case when x='st' and i>1 and len(list_filter(w[i+1:], lambda y: y not in ({','.join(map(q, tx.COMPASS))})))=0 then 'street' else {case_sql('x', tx.STREET_TYPES, 'x')} end), ' ') as street from (select id, string_split(lower(s), ' ') w from ({STREETS}))")
def x07(spark, sf):
    return street_names(spark, sf).select("id", F.array_join(tx.street_types(tx.words(F.lower("s"))), " ").alias("street"))


@query("x08_ordinals", "select p_partkey as id, concat(cast(p_size as varchar), case when p_size % 100 between 11 and 13 then 'th' when p_size%10=1 then 'st' when p_size%10=2 then 'nd' when p_size%10=3 then 'rd' else 'th' end, ' street') as o from part")
def x08(spark, sf):
    """A bare number before a street type becomes its ordinal."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    t = F.array(F.col("p_size").cast("string"), F.lit("street"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(tx.ordinals(t, house_first=False), " ").alias("o"))


@query("x04_user_tokens")
def x04(spark, sf):
    """Whole query tokenisation; its cases are tested one by one."""
    raw = street_names(spark, sf).select("id", F.concat(F.col("id").cast("string"), F.lit(" "), F.col("s"), F.lit(", St. Kilda")).alias("q"))
    return tx.user_tokens(raw, "id", "q").select("id", F.array_join("tokens", " ").alias("tokens"))


UNITS = "select o_orderkey as id, concat(list_extract(['Apt ','UNIT ','#','Suite ',''], cast(o_orderkey % 5 + 1 as bigint)), cast(o_orderkey % 40 as varchar), 'B') as u from orders"


@query("x09_unit_key", f"select id, regexp_replace(lower(trim(regexp_replace(trim(u), '^#+', ''))), '^(?:{'|'.join(tx.UNIT_WORDS)})\\s+', '') as unit from ({UNITS})")
def x09(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.get(F.array(*map(F.lit, ("Apt ", "UNIT ", "#", "Suite ", ""))), (F.col("o_orderkey") % 5).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), tx.unit_key(F.concat(k, (F.col("o_orderkey") % 40).cast("string"), F.lit("B"))).alias("unit"))


@query("x10_postcodes", "select c_custkey as id, case when c_custkey%3=0 then concat(left(p,3),' ',right(p,3)) when c_custkey%3=1 then concat(left(p,len(p)-3),' ',right(p,3)) else p end as shown from (select c_custkey, upper(regexp_replace(c_phone,'[^A-Za-z0-9]','','g')) p from (select c_custkey, concat('a', cast(c_custkey%10 as varchar), 'b ', cast(c_custkey%7 as varchar), 'c-', cast(c_custkey%9 as varchar)) c_phone from customer))")
def x10(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    raw = F.concat(F.lit("a"), (k % 10).cast("string"), F.lit("b "), (k % 7).cast("string"), F.lit("c-"), (k % 9).cast("string"))
    cc = F.when(k % 3 == 0, "CA").when(k % 3 == 1, "GB").otherwise("AU")
    return c.select(k.alias("id"), tx.display_postcode(raw, cc).alias("shown"))


@query("x12_states", f"select n_nationkey as id, {case_sql('s', tx.AU_STATES, 'null')} as au, {case_sql('upper(s)', tx.CA_PROVINCES, 'null')} as ca, {case_sql('upper(s)', tx.US_STATES, 'null')} as us from (select n_nationkey, list_extract(['nsw','vic','wa','nt','on','qc','ca','ny'], cast(n_nationkey % 8 + 1 as bigint)) s from nation)")
def x12(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    s = F.get(F.array(*map(F.lit, ("nsw", "vic", "wa", "nt", "on", "qc", "ca", "ny"))), (F.col("n_nationkey") % 8).cast("int"))
    return n.select(F.col("n_nationkey").alias("id"), F.try_element_at(tx.mapping(tx.AU_STATES), s).alias("au"), F.try_element_at(tx.mapping(tx.CA_PROVINCES), F.upper(s)).alias("ca"), F.try_element_at(tx.mapping(tx.US_STATES), F.upper(s)).alias("us"))


HOUSE = tg.cte("addresses") + ", p as (select id, housenumber h, cast(regexp_extract(split_part(housenumber,'-',1),'^(\\d+)',1) as bigint) f, cast(regexp_extract(case when position('-' in housenumber)>0 then split_part(housenumber,'-',2) else housenumber end,'^(\\d+)',1) as bigint) l, regexp_replace(split_part(housenumber,'-',1),'^\\d+','') s from addresses)"


@query("x14_house_ranges", HOUSE + " select id, least(f,l) as first, greatest(f,l) as last, s as suffix, (lower(h)='42a' or ((s='a' or s='A' or (s='' and f<>l)) and least(f,l)<=42 and greatest(f,l)>=42)) as has_42a, (h='42' or (least(f,l)<=42 and greatest(f,l)>=42)) as has_42 from p")
def x14(spark, sf):
    a = tg.table(spark, sf, "addresses")
    p = tx.parse_house(F.col("housenumber"))
    return a.select("id", p["first"].alias("first"), p["last"].alias("last"), p["suffix"].alias("suffix"), tx.house_matches(F.lit("42A"), F.col("housenumber")).alias("has_42a"), tx.house_matches(F.lit("42"), F.col("housenumber")).alias("has_42"))


@query("x15_split_house", "select o_orderkey as id, case o_orderkey%3 when 0 then concat('Apt ', cast(o_orderkey%9 as varchar)) when 1 then cast(o_orderkey%9 as varchar) end as unit, case o_orderkey%3 when 2 then '12-14' else '12' end as number from orders")
def x15(spark, sf):
    o, k = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    n = (k % 9).cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" Apt "), n, F.lit(" / 12"))).when(k % 3 == 1, F.concat(n, F.lit("/12"))).otherwise("12-14")
    s = tx.split_house(raw)
    return o.select(k.alias("id"), s["unit"].alias("unit"), s["number"].alias("number"))


@query("x13_au_unit", "select o_orderkey as id, case when o_orderkey%2=0 then cast(o_orderkey%9 as varchar) end as unit, case when o_orderkey%2=0 then '827a' end as number from orders")
def x13(spark, sf):
    o, k = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    s = tx.au_unit(F.when(k % 2 == 0, F.concat((k % 9).cast("string"), F.lit(" / 827a"))).otherwise("12-14"))
    return o.select(k.alias("id"), s["unit"].alias("unit"), s["number"].alias("number"))


@query("x18_title_case", "select p_partkey as id, array_to_string(list_transform(string_split(p_name,' '), lambda w: concat(upper(left(w,1)), lower(substring(w,2)))), ' ') as title from part")
def x18(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), tx.title_case(F.upper("p_name")).alias("title"))


@query("x20_articles_and_short_forms", "select p_partkey as id, case when p_partkey%2=0 then p_name end as bare, split_part(p_name,' ',1) as short from part")
def x20(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    k, name = F.col("p_partkey"), F.col("p_name")
    with_article = F.concat(F.get(F.array(*map(F.lit, ("The ", "", "l'", ""))), (k % 4).cast("int")), name)
    return p.select(k.alias("id"), tx.strip_article(with_article).alias("bare"), tx.short_form(F.concat(F.split_part(name, F.lit(" "), F.lit(1)), F.lit(" am "), name)).alias("short"))


@query("x28_name_match", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey=b.n_regionkey where contains(lower(a.n_name), lower(b.n_name)) or contains(lower(b.n_name), lower(a.n_name)) or a.n_name=b.n_name")
def x28(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey", F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").where(tx.name_matches(F.col("x"), F.col("y"))).select("a", "b")


@query("x31_country_label", "select event_type, case when regexp_matches(event_type,'^[A-Za-z]{2}$') then lower(event_type) else 'unknown' end as label, count(*) as n from (select case when event_id%3=0 then 'AU' when event_id%3=1 then ' nz ' else event_type end event_type from (select event_id, trim(event_type) event_type from events)) group by 1,2".replace("' nz '", "'nz'"))
def x31(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = F.when(F.col("event_id") % 3 == 0, "AU").when(F.col("event_id") % 3 == 1, "nz").otherwise(F.col("event_type"))
    return e.select(t.alias("event_type")).groupBy("event_type", tx.country_label(F.col("event_type")).alias("label")).agg(F.count("*").alias("n"))


@query("x34_strata", tg.cte("addresses") + " select case when unit is not null then 'unit' when housenumber like '%-%' then 'range' when regexp_matches(housenumber,'[A-Za-z]') then 'suffix' else 'plain' end as stratum, count(*) as n from addresses group by 1")
def x34(spark, sf):
    return tg.table(spark, sf, "addresses").groupBy(tx.stratum(F.col("housenumber"), F.col("unit")).alias("stratum")).agg(F.count("*").alias("n"))


@query("x30_escapes", """select doc_id, case when regexp_matches(t,'[,"\r\n]') then concat('"', replace(t,'"','""'), '"') else t end as csv from (select doc_id, text t from documents)""")
def x30(spark, sf):
    return docs(spark, sf).select("doc_id", tx.csv_field(F.col("text")).alias("csv"))


@query("x29_normalizers", "select p_partkey as id, regexp_replace(concat(cast(p_size as varchar), case when p_size % 100 between 11 and 13 then 'TH' when p_size%10=1 then 'ST' when p_size%10=2 then 'ND' when p_size%10=3 then 'RD' else 'TH' end, ' ', upper(p_name)), '([0-9]+)(ST|ND|TH|RD)', '\\1', 'g') as plain from part")
def x29(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), tx.remove_ordinals(F.concat(F.upper(tx.ordinal(F.col("p_size"))), F.lit(" "), F.upper("p_name"))).alias("plain"))


@query("r08_whole_phrase", "select doc_id, contains(concat(' ', regexp_replace(text,'[^\\p{L}\\p{N}]+',' ','g'), ' '), ' of the ') as hit from documents")
def r08(spark, sf):
    return docs(spark, sf).select("doc_id", tx.whole_phrase(F.col("text"), F.lit("of the")).alias("hit"))


@query("f24_length_caps", "select doc_id, strlen(text) <= 2048 as ok from documents")
def f24(spark, sf):
    return docs(spark, sf).select("doc_id", (F.octet_length("text") <= 2048).alias("ok"))


@query("js1_dot_path", "select event_id, cast(json_extract(props,'$.k') as bigint) as k from events")
def js1(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("r17_spelling_distance", "select a.w as w, b.w as v from (select distinct split_part(p_name,' ',1) w from part) a join (select distinct split_part(p_name,' ',2) w from part) b on damerau_levenshtein(a.w,b.w) <= 2")
def r17(spark, sf):
    """Words of one list within two edits of the other, swaps counting one; they meet on what deletions leave."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    from geoquill.operators.search import deletions

    half = lambda k, name: p.select(F.split_part("p_name", F.lit(" "), F.lit(k)).alias(name)).distinct().withColumn("key", F.explode(deletions(F.col(name), F.lit(2))))
    return half(1, "w").join(half(2, "v"), "key").select("w", "v").distinct().where(tx.osa_distance(F.col("w"), F.col("v"), 2))
