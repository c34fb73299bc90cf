"""Search over a small written-down index: every rung of the ladder and every key of the ranking, with the hits it must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.operators import build as bd
from geoquill.operators import ladder
from geoquill.operators import search as se

Q: dict = {}
SQL: dict = {}

#: doc_id, country, kind, name, locality, state, housenumber, unit, postcode, rank, importance, lat, lng
DOCS = [
    (1, "AU", 1, "Sydney", None, "New South Wales", None, None, None, 16, 210, -33.87, 151.21),
    (2, "CA", 1, "Sydney", None, "Nova Scotia", None, None, None, 16, 60, 46.14, -60.19),
    (3, "AU", 2, "George Street", "Sydney", "New South Wales", None, None, None, 26, 0, -33.87, 151.207),
    (4, "AU", 2, "George Street", "Orange", "New South Wales", None, None, None, 26, 0, -33.28, 149.1),
    (5, "AU", 4, "George Street", "Sydney", "New South Wales", "12", None, "2000", 30, 0, -33.868, 151.207),
    (6, "AU", 4, "George Street", "Sydney", "New South Wales", "12", "3", "2000", 30, 0, -33.868, 151.207),
    (7, "AU", 4, "George Street", "Orange", "New South Wales", "14", None, "2800", 30, 0, -33.281, 149.1),
    (8, "AU", 1, "Orange", None, "New South Wales", None, None, None, 16, 90, -33.28, 149.1),
    (9, "AU", 3, "George Street Cafe", "Orange", "New South Wales", None, None, None, 15, 5, -33.28, 149.101),
    (10, "US", 1, "Springfield", None, "Illinois", None, None, None, 16, 120, 39.8, -89.65),
    (11, "US", 1, "Springfield", None, "Ohio", None, None, None, 16, 80, 39.92, -83.81),
    (12, "US", 4, "North Main Street", "Springfield", "Illinois", "5", None, "62701", 30, 0, 39.8, -89.65),
    (13, "US", 2, "Main Street", "Ontario", "California", None, None, None, 26, 0, 34.06, -117.65),
    (14, "CA", 2, "Main Street", "Ontario", "Alberta", None, None, None, 26, 0, 51.0, -114.0),
    (15, "US", 1, "New York", None, "New York", None, None, None, 16, 250, 40.71, -74.0),
    (16, "US", 2, "Broadway", "New York", "New York", None, None, None, 26, 0, 40.75, -73.98),
    (17, "US", 3, "New York Pizza on Broadway", "Tucson", "Arizona", None, None, None, 15, 9, 32.2, -110.9),
    (18, "AU", 1, "Richmond", None, "Victoria", None, None, None, 19, 70, -37.82, 145.0),
    (19, "AU", 1, "Richmond", None, "Queensland", None, None, None, 19, 40, -20.73, 143.14),
    (20, "AU", 4, "Otara Road", "Richmond", "Victoria", "7", None, "3121", 30, 0, -37.82, 145.001),
]
COLUMNS = "doc_id long, country string, kind int, name string, locality string, state string, housenumber string, unit string, postcode string, rank int, importance int, lat double, lng double"
#: A query (text, country, bias) and the hits (document, rung) that it must give, best first.
QUERIES = {
    1: ("Sydney", None, None, [(1, 2), (2, 2), (3, 2)]),
    2: ("Sydney", "CA", None, [(2, 2)]),
    3: ("George Street Sydney", "AU", None, [(3, 2)]),
    4: ("12 George St Sydney", "AU", None, [(5, 2)]),
    5: ("3/12 George Street Sydney", "AU", None, [(6, 2)]),
    6: ("9/12 George Street Sydney", "AU", None, [(5, 3)]),
    7: ("12 George Street Sydney 2999", "AU", None, [(5, 4)]),
    8: ("99 George Street Sydney", "AU", None, [(3, 7)]),
    9: ("2800", "AU", None, [(7, 1)]),
    10: ("George Street, Orange, Nowhere", "AU", None, [(4, 8), (3, 8), (9, 8)]),
    11: ("5 N Main St Springfield", "US", None, [(12, 2)]),
    12: ("Springfield, Ohio", "US", None, [(11, 0)]),
    13: ("Springfield", "US", None, [(10, 2), (11, 2)]),
    14: ("Springfield", "US", (39.9, -83.8), [(11, 2), (10, 2)]),
    15: ("Broadway New York", "US", None, [(17, 2), (16, 2)]),
    16: ("Richmond Victoria", "AU", None, [(18, 2)]),
    17: ("George Street Sydney Australia", None, None, [(3, 2)]),
    18: ("Main Street, Ontario, CA", None, None, [(13, 2), (14, 2)]),
    19: ("7 Otara Road Ричмонд", "AU", None, [(20, 9)]),
    20: ("Zzyzx", "AU", None, []),
    21: ("NYC", "US", None, [(15, 2)]),
    22: ("George Street", "AU", None, [(3, 2), (4, 2), (9, 2)]),
    23: ("Broadway NYC", "US", None, [(16, 2)]),
}


def _tables(spark):
    none = spark.createDataFrame([], "id long, alias string")
    docs = bd.with_alternates(spark.createDataFrame(DOCS, COLUMNS), none)
    return docs, se.postings(docs, ladder.FIELDS, ["country"]), se.field_lengths(docs, ladder.FIELDS, ["country"])


def _queries(spark):
    rows = [(k, q, cc, *(b or (None, None))) for k, (q, cc, b, _) in QUERIES.items()]
    return spark.createDataFrame(rows, "qid long, q string, country string, lat double, lng double")


def _run(spark):
    docs, index, lengths = _tables(spark)
    aliases = spark.createDataFrame([("NYC", 15)], "alias string, doc_id long")
    return ladder.search(_queries(spark), docs, index, lengths, aliases)


def query(name: str, sql: str):
    def wrap(f):
        Q[name], SQL[name] = f, sql
        return f

    return wrap


def values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL."""
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


@query("r16_search_rungs", values([(k, p + 1, d, r) for k, (*_, hits) in QUERIES.items() for p, (d, r) in enumerate(hits)], "qid, pos, doc_id, rung").replace("select *", "select cast(qid as bigint) as qid, cast(pos as bigint) as pos, cast(doc_id as bigint) as doc_id, cast(rung as int) as rung"))
def r16(spark, sf):
    """All rungs and the merge of countries: queries with the hits and the rung they must give."""
    return _run(spark).select("qid", "pos", "doc_id", "rung")


_SUFFIXES = [
    (1, "10 King St, Newtown, Australia", None, "10 King St, Newtown", "AU"), (2, "Auckland New Zealand", None, "Auckland", "NZ"), (3, "Boston, USA", None, "Boston", "US"), (4, "Sydney", None, "Sydney", None),
    (5, "Paris FR", "FR", "Paris", "FR"), (6, "Paris FR", None, "Paris FR", None), (7, "London UK", "US", "London UK", "US"), (8, "Berlin, Germany", None, "Berlin", "DE"), (9, "Australia", None, "Australia", None), (10, "Perth AU", "AU,NZ", "Perth", "AU"),
]


@query("r22_country_suffixes", values([(k, b, c) for k, _, _, b, c in _SUFFIXES], "qid, q, country").replace("select *", "select cast(qid as bigint) as qid, q, country"))
def r22(spark, sf):
    q = spark.createDataFrame([r[:3] for r in _SUFFIXES], "qid long, q string, country string")
    return ladder.country_suffix(q, spark.createDataFrame([("germany", "DE")], "name string, cc string")).select("qid", "q", "country")


_CITIES = [(1, "Broadway New York", "US", "Broadway", "New York"), (2, "George Street Sydney", None, "George Street", "Sydney"), (3, "George Street Richmond", "AU", None, None), (4, "New York", "US", None, None), (5, "Main St, Sydney", "AU", None, None)]


@query("r11_trailing_cities", values([(k, b, c) for k, _, _, b, c in _CITIES if b], "qid, body, city").replace("select *", "select cast(qid as bigint) as qid, body, city"))
def r11(spark, sf):
    """The town that a query ends in; suburbs and queries with commas have none, nor has a town's name alone."""
    q = spark.createDataFrame([r[:3] for r in _CITIES], "qid long, q string, country string").withColumns({"city": F.lit(None).cast("string"), "street": F.lit(None).cast("string")})
    return ladder.trailing_city(q, _tables(spark)[0]).select("qid", "body", "city")


_GRADES = [("Sydney", "", "", "sydney", 3), ("George Street", "Sydney", "New South Wales", "george street sydney", 2), ("Richmond", "", "Victoria", "richmond victoria", 1), ("Richmond", "", "Victoria", "victoria richmond", 0), ("Park", "", "", "park lane", 0)]


@query("w02_explained_grades", values([(n, t, g) for n, _, _, t, g in _GRADES], "name, typed, grade").replace("select *", "select name, typed, cast(grade as int) as grade"))
def w02(spark, sf):
    d = spark.createDataFrame([r[:4] for r in _GRADES], "name string, locality string, state string, typed string")
    return d.select("name", "typed", ladder.grade(F.col("name"), F.col("locality"), F.col("state"), F.split("typed", " ")).alias("grade"))


@query("t04_oversample", "select p_partkey as id, case when p_partkey%3=0 then least(greatest(p_size*30,3000),10000) when p_partkey%3=1 then least(greatest(p_size*3,100),150) else least(p_size*3,150) end as n from part")
def t04(spark, sf):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), ladder.oversample(F.col("p_size"), k % 3 == 0, k % 3 == 1).alias("n"))


@query("r12_ranking_keys", "select p_partkey as id, case when p_partkey%2=0 then p_partkey%3=0 else p_partkey%3=0 and p_partkey%5=0 and km<=150 end as exact, round(case when p_partkey%2=0 and p_partkey%3=0 then p_size when p_partkey%2=1 and p_partkey%3=0 and p_partkey%5=0 and km<=150 then -km else p_retailprice end, 4) as key from (select *, cast(p_partkey%400 as double) as km from part)")
def r12(spark, sf):
    """Exact names by importance; near a point exact places nearest first; the rest by score."""
    k = F.col("p_partkey")
    rk = ladder.ranking_key(F.when(k % 5 == 0, bd.PLACE).otherwise(bd.POI), k % 3 == 0, F.col("p_size"), F.when(k % 2 == 1, (k % 400).cast("double")), F.col("p_retailprice"))
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), rk.alias("rk")).select("id", "rk.exact", F.round("rk.key", 4).alias("key"))


_CHECKED = [
    (1, "12 George Street Sydney", "AU", "verified"), (2, "9/12 George Street Sydney", "AU", "corrected"), (3, "12 George Street Sydney 2999", "AU", "corrected"), (4, "99 George Street Sydney", "AU", "partial"),
    (5, "Zzyzx", "AU", "unverified"), (6, "Springfield", "US", "verified"),
]


def _engine(spark):
    from geoquill.engine import Engine

    return Engine({"documents": spark.createDataFrame(DOCS, COLUMNS)})


@query("api_validate", values([(k, v) for k, _, _, v in _CHECKED], "qid, verdict").replace("select *", "select cast(qid as bigint) as qid, verdict"))
def api_validate(spark, sf):
    q = spark.createDataFrame([r[:3] for r in _CHECKED], "qid long, q string, country string")
    return _engine(spark).validate(q).select("qid", "verdict")


@query("api_search", values([(k, p + 1, d) for k in (1, 4, 8, 12, 14, 21) for p, (d, _) in enumerate(QUERIES[k][3])], "qid, pos, doc_id").replace("select *", "select cast(qid as bigint) as qid, cast(pos as bigint) as pos, cast(doc_id as bigint) as doc_id"))
def api_search(spark, sf):
    aliases = spark.createDataFrame([("NYC", 15)], "alias string, doc_id long")
    return _engine(spark).ranked_search(_queries(spark).where("qid in (1, 4, 8, 12, 14, 21)"), aliases).select("qid", "pos", "doc_id")


_SPACED = [(1, "14 Geor ge Street Orange", "AU", 7), (2, "14 GeorgeStreet Orange", "AU", 7), (3, "14 George Street Orange", "AU", None), (4, "no such", "AU", None), (5, "5 North Ma in Street Springfield", "US", 12)]


@query("api_repair", values([(k, d) for k, _, _, d in _SPACED if d], "qid, doc_id").replace("select *", "select cast(qid as bigint) as qid, cast(doc_id as bigint) as doc_id"))
def api_repair(spark, sf):
    """White space put wrong once, answered where one address alone is found."""
    q = spark.createDataFrame([r[:3] for r in _SPACED], "qid long, q string, country string")
    return _engine(spark).repair(q).select("qid", "doc_id")


_MISSPELT = [(1, "12 Goerge Street", "AU", "12 george street"), (2, "Sprinfgield", "US", "springfield"), (3, "George Street", "AU", None)]


@query("api_respell", values([(k, x) for k, _, _, x in _MISSPELT if x], "qid, q").replace("select *", "select cast(qid as bigint) as qid, q"))
def api_respell(spark, sf):
    q = spark.createDataFrame([r[:3] for r in _MISSPELT], "qid long, q string, country string")
    return _engine(spark).respell(q, 1).select("qid", "q")
