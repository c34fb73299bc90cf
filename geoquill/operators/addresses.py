"""Look-up of addresses by number, street and unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.functions import text as tx
from geoquill.sources.shared import kept

from . import spatial as sp

#: Rows of pairs of distinct texts that every task may hold, and numbers of a bucket in which ranges meet.
HELD, BUCKET = 500_000, 1024


def _held(pairs: DataFrame, kind: str) -> DataFrame:
    """Pairs of texts, written once; given to every task if they are counted to be few."""
    rows = kept(pairs, kind)
    return F.broadcast(rows) if rows.count() <= HELD else rows


def matching_houses(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(_house, housenumber): each distinct number asked for with the distinct stored ones that match it."""
    span = lambda c: F.explode_outer(F.when(c["first"] <= c["last"], F.sequence(F.floor(c["first"] / BUCKET), F.floor(c["last"] / BUCKET)))).alias("_b")
    a = queries.select(F.col("q_house").alias("_house")).where("_house is not null").distinct()
    s = points.select("housenumber").where("housenumber is not null").distinct()
    near = a.select("_house", span(tx.parse_house(F.col("_house")))).join(s.select("housenumber", span(tx.parse_house(F.col("housenumber")))), "_b").drop("_b").distinct()
    near = near.where(tx.house_matches(F.col("_house"), F.col("housenumber")))
    same = a.join(s, F.lower("_house") == F.lower("housenumber"))
    return near.unionByName(same).distinct()


def by_house(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_house``: a point is listed under every number asked for that it answers to."""
    return queries.withColumn("_house", F.col("q_house")), points.join(_held(matching_houses(queries, points), "houses"), "housenumber")


def find_address(queries: DataFrame, points: DataFrame, deg: float, ladder: list[tuple[int, Column]]) -> DataFrame:
    """Nearest address with the number asked for, from the first source of the ladder that has one.

    ``queries``: qid, lat, lng, q_house, q_street (null: any), q_unit (null: any, those without one first). ``points``: id,
    lat, lng, housenumber, street, unit, source. ``ladder``: (source, whether the query may use it), in order.

    Distinct numbers and names meet once, as texts; then number and name are equal, and the nearest is searched among those.
    A unit asked for is searched by its key, and beside it the nearest of any unit, which stands where none has it.
    """
    bits = F.lit(0).cast("long")
    for k, (_, may) in enumerate(ladder):
        bits = bits + F.when(may, F.lit(3 << (2 * k))).otherwise(0)
    stored = F.coalesce("unit", F.lit(""))
    q, p = by_house(queries.withColumn("_bits", bits), points)
    steps = F.filter(F.array(*[F.when(F.col("source") == s, F.lit(k)) for k, (s, _) in enumerate(ladder)]), lambda k: k.isNotNull())
    p = p.withColumns({"_unit": tx.unit_key(stored), "_step": F.explode(steps)})
    asked, named = q.where("q_street is not null"), None
    rows = None
    for street in (True, False):
        some, on = q.where("q_street is not null" if street else "q_street is null"), ["_house"]
        if street:
            if named is None:
                texts = asked.select("q_street").distinct().crossJoin(points.select(F.col("street").alias("_street")).where("_street is not null").distinct())
                a, b = F.lower("q_street"), F.lower("_street")
                named = texts.where(F.contains(a, b) | F.contains(b, a))
            on.append("_street")
        for unit in (False, True):
            mine = some.where("q_unit is not null" if unit else "q_unit is null")
            if mine.isEmpty():
                continue
            if street:
                mine = mine.join(_held(named, "streets"), "q_street")
            here = p.withColumn("_street", F.col("street"))
            if unit:
                got = sp.close_rows(mine.withColumn("_unit", tx.unit_key(F.col("q_unit"))), here, deg, on=(*on, "_unit"), rung=2 * F.col("_step"), may=F.col("_bits"))
                got = got.select(*[c for c in got.columns if not c.startswith("_")])
                more = sp.close_rows(mine, here, deg, on=tuple(on), rung=2 * F.col("_step"), may=F.col("_bits"))
                got = got.unionByName(more.select(*got.columns))
            else:
                got = sp.close_rows(mine, here, deg, on=tuple(on), rung=2 * F.col("_step") + (stored != "").cast("int"), may=F.col("_bits"))
                got = got.select(*[c for c in got.columns if not c.startswith("_")])
            rows = got if rows is None else rows.unionByName(got)
    if rows is None:
        rows = sp.cell_join(queries, points, deg).where("false").drop("d")
    rung = F.lit(None).cast("int")
    for k, (source, may) in enumerate(ladder):
        rung = F.coalesce(rung, F.when((F.col("source") == source) & may, k))
    tier = F.when(F.col("q_unit").isNull(), (stored != "").cast("int")).otherwise((tx.unit_key(stored) != tx.unit_key(F.col("q_unit"))).cast("int"))
    rows = rows.withColumn("d", sp.geo.dist_sq(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))
    rows = rows.withColumn("rung", rung).where("rung is not null").withColumn("tier", tier)
    return sp.best(rows, ["qid"], [F.col("rung"), F.col("tier"), F.col("d"), F.col("id")]).drop("rn")
