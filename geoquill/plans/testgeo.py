"""Binding of the driver's tables to the geographic model, once for Spark and once as DuckDB CTEs.

No coordinates exist in those tables, so they are made by fixed integer arithmetic. Expressions are plain enough that
both engines read the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquill.functions import geo


def _lat(k: str, off: int = 0) -> str:
    return f"(cast(({k}*7919+{off}) % 120000 as double)/1000 - 60)"


def _lng(k: str, off: int = 0) -> str:
    return f"(cast(({k}*104729+{off}) % 340000 as double)/1000 - 170)"


#: name -> (source table, select list)
TABLES = {
    "coords": ("customer", f"c_custkey as qid, {_lat('c_custkey')} as lat, {_lng('c_custkey')} as lng"),
    "places": ("supplier", f"s_suppkey as id, s_name as name, {_lat('s_suppkey', 311)} as lat, {_lng('s_suppkey', 977)} as lng, cast(16 + s_suppkey % 10 as int) as rank, cast(s_suppkey*37 % 256 as int) as importance"),
    "pois": ("part", f"p_partkey as id, p_name as name, {_lat('p_partkey', 53)} as lat, {_lng('p_partkey', 29)} as lng, case when p_partkey % 3 = 0 then 10 else 15 end as rank, concat(lower(p_type), ':', lower(p_brand)) as category"),
    "addresses": ("orders", f"o_orderkey as id, {_lat('o_custkey', 7)} + cast(o_orderkey % 7 as double)/5000 as lat, {_lng('o_custkey', 11)} + cast(o_orderkey % 11 as double)/5000 as lng, "
                  "case when o_orderkey % 5 = 0 then concat(cast(o_orderkey % 90 + 1 as varchar(20)), 'A') when o_orderkey % 5 = 1 then concat(cast(o_orderkey % 90 + 1 as varchar(20)), '-', cast(o_orderkey % 90 + 5 as varchar(20))) else cast(o_orderkey % 90 + 1 as varchar(20)) end as housenumber, "
                  "concat('Street ', cast(o_custkey % 40 as varchar(20))) as street, case when o_orderkey % 4 = 0 then cast(o_orderkey % 9 + 1 as varchar(20)) end as unit, cast(1000 + o_custkey % 50 as varchar(20)) as postcode, concat('Town ', cast(o_custkey % 25 as varchar(20))) as city, cast(o_orderkey % 3 as int) as source"),
    "ways": ("part", f"p_partkey as id, p_name as name, {_lat('p_partkey', 1009)} as lat0, {_lng('p_partkey', 2003)} as lng0, cast(p_partkey % 9 - 4 as double)/100 as dlat, cast(p_partkey % 7 - 3 as double)/100 as dlng, cast(p_size * 2 as double) as start_no, cast(p_size * 2 + 40 as double) as end_no, cast(p_partkey % 3 as int) as kind"),
    "boxes": ("nation", "cast(n_nationkey as int) as k, n_name as name, n_regionkey as region, -60 + 24*floor(n_nationkey/5) as y0, cast(-170 + 68*(n_nationkey % 5) as double) as x0"),
    "requests": ("events", "event_id, ts, user_id, event_type as endpoint, value as ms"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, select = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(f"select {select} from {{df}}", df=df)


def cte(*names: str) -> str:
    return "with " + ", ".join(f"{n} as (select {TABLES[n][1]} from {TABLES[n][0]})" if n in TABLES else f"{n} as ({EXTRA[n]})" for n in names)


#: CTEs that only the oracle needs; Spark makes the same tables by functions below.
EXTRA = {
    "polys": "select cast(k*10 as bigint) as id, name, cast(2 as int) as level, y0, x0, y0+24 as y1, x0+68 as x1, cast(24*68 as double) as area, k from boxes union all "
    "select k*10+1, concat(name, ' South'), 4, y0, x0, y0+12, x0+68, cast(12*68 as double), k from boxes union all "
    "select k*10+2, concat(name, ' North'), 4, y0+12, x0, y0+24, x0+68, cast(12*68 as double), k from boxes union all "
    "select k*10+3, concat(name, ' Core'), 4, y0+8, x0+20, y0+16, x0+40, cast(8*20 as double), k from boxes union all "
    "select k*10+4, concat(name, ' Town'), 8, y0+8, x0+20, y0+16, x0+40, cast(8*20 as double), k from boxes",
}


def _ring(y0, x0, y1, x1):
    v = lambda y, x: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lng"))
    return F.array(v(y0, x0), v(y0, x1), v(y1, x1), v(y1, x0))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries (level 2), halves and a core (4) and a town (8) as rings."""
    b = table(spark, sf_dir, "boxes")
    y, x = F.col("y0"), F.col("x0")
    parts = [("", 0, 2, 0, 0, 24, 68), (" South", 1, 4, 0, 0, 12, 68), (" North", 2, 4, 12, 0, 24, 68), (" Core", 3, 4, 8, 20, 16, 40), (" Town", 4, 8, 8, 20, 16, 40)]
    rows = [
        F.struct((F.col("k") * 10 + i).cast("long").alias("id"), F.concat("name", F.lit(tail)).alias("name"), F.lit(level).alias("level"), _ring(y + a, x + c, y + d, x + e).alias("ring"), F.col("k"))
        for tail, i, level, a, c, d, e in parts
    ]
    out = b.select(F.inline(F.array(*rows)))
    return out.withColumn("area", geo.ring_area(F.col("ring")))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of three nodes with a bend, from the second on two thirds of the step is to the north."""
    w = table(spark, sf_dir, "ways")
    n = lambda a, b: F.struct((F.col("lat0") + a * F.col("dlat")).alias("lat"), (F.col("lng0") + b * F.col("dlng")).alias("lng"))
    return w.select("id", "name", "start_no", "end_no", "kind", F.array(n(0, 0), n(1, 1), n(3, 2)).alias("nodes"))
