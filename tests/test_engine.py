"""The engine end to end on a small country."""

import pytest
from pyspark.sql import functions as F

from geoquill.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    box = lambda y0, x0, y1, x1: [(float(y0), float(x0)), (float(y0), float(x1)), (float(y1), float(x1)), (float(y1), float(x0))]
    ring = "array<struct<lat:double,lng:double>>"
    polygons = spark.createDataFrame([(1, "Australia", 2, box(-40, 140, -10, 155), 450.0, "AU"), (2, "New South Wales", 4, box(-37, 141, -28, 154), 117.0, "AU"), (3, "Bondi", 9, box(-33.95, 151.2, -33.85, 151.3), 0.01, "AU"), (4, "Station", 9, box(-37, 141, -28, 154), 117.0, "AU")], f"id long, name string, level int, ring {ring}, area double, country_code string")
    mapping = spark.createDataFrame([(None, 2, "country", None), (None, 4, "state", None), (None, 8, "city", None), ("AU", 9, "city", 0.05)], "country_code string, level int, field string, max_area double")
    addresses = spark.createDataFrame([(1, -33.9, 151.25, "12A", "Campbell Parade", None, "2026", "Bondi", 1), (2, -33.9, 151.2502, "14", "Campbell Parade", "3", "2026", "Bondi", 0)], "id long, lat double, lng double, housenumber string, street string, unit string, postcode string, city string, source int")
    ways = spark.createDataFrame([(7, "Hall Street", [(-33.88, 151.25), (-33.88, 151.26)], 1.0, 21.0, 2)], f"id long, name string, nodes {ring}, start_no double, end_no double, kind int")
    places = spark.createDataFrame([(1, "Sydney", -33.87, 151.21, 16, 200), (2, "Orange", -33.28, 149.1, 16, 90)], "id long, name string, lat double, lng double, rank int, importance int")
    rows = [(1, "AU", 1, "Sydney", None, "New South Wales", None, None, None, 16, 200), (2, "AU", 4, "Campbell Parade", "Bondi", None, "12A", None, "2026", 26, 0), (3, "AU", 2, "Campbell Parade", "Bondi", None, None, None, None, 26, 0), (4, "NZ", 1, "Sydney", None, None, None, None, None, 20, 1), (5, "AU", 3, "The Rocks", "Sydney", None, None, None, None, 15, 20)]
    documents = spark.createDataFrame(rows, "doc_id long, country string, kind int, name string, locality string, state string, housenumber string, unit string, postcode string, rank int, importance int").withColumns({"lat": F.lit(-33.9), "lng": F.lit(151.2)})
    ranges = spark.createDataFrame([(100, 200, -33.9, 151.25)], "lo long, hi long, lat double, lng double")
    return Engine({"polygons": polygons, "mapping": mapping, "addresses": addresses, "ways": ways, "places": places, "documents": documents, "ranges": ranges})


def test_reverse(spark, engine):
    q = spark.createDataFrame([(1, -33.9, 151.2501), (2, -33.8801, 151.2549), (3, -30.0, 145.0), (4, 10.0, 10.0)], "qid int, lat double, lng double")
    got = {r.qid: r for r in engine.reverse(q).collect()}
    assert got[1].formatted == "14 Campbell Parade, Bondi, New South Wales 2026, Australia" and got[1].confidence == "exact"
    assert got[2].road == "Hall Street" and got[2].house_number == "11" and got[2].confidence == "interpolated"
    assert got[3].formatted == "New South Wales, Australia" and got[3].city is None and got[3].confidence == "fallback"
    assert got[4].formatted is None
    assert engine.ip(spark.createDataFrame([(9, 150)], "qid int, ip long")).first().road == "Campbell Parade"


def test_search_and_validate(spark, engine):
    q = spark.createDataFrame([(1, "12A Campbell Pde, Bondi", "AU"), (2, "Sydney", "AU"), (3, "Sydney", None), (4, "99 Campbell Parade", "AU"), (5, "Nowhere", "AU"), (6, "12A Campbell Parade 2027", "AU"), (7, "Rocks", "AU")], "qid int, q string, country string")
    got = {}
    for r in engine.search(q).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.rung))
    assert got[1] == [(2, 0)] and got[2] == [(1, 0), (5, 0)] and [d for d, _ in got[3]][:2] == [1, 5] and 4 in [d for d, _ in got[3]]
    assert {x[1] for x in got[4]} == {3} and 5 not in got and got[6] == [(2, 2)] and got[7] == [(5, 0)]
    verdicts = {r.qid: r.verdict for r in engine.validate(q).collect()}
    assert verdicts == {1: "verified", 2: "verified", 3: "verified", 4: "partial", 5: "unverified", 6: "corrected", 7: "verified"}


def test_nearby_and_autocomplete(spark, engine):
    q = spark.createDataFrame([(1, -33.9, 151.2)], "qid int, lat double, lng double")
    assert [r.name for r in engine.nearby(q, 10_000).collect()] == ["Sydney"]
    assert [r.name for r in engine.nearby(q, 300_000).orderBy("pos").collect()] == ["Sydney", "Orange"]
    p = spark.createDataFrame([(1, "au", "Roc"), (2, "AU", "s"), (3, "AU", "")], "qid int, country string, prefix string")
    assert {(r.qid, r.id) for r in engine.autocomplete(p).collect()} == {(1, 5), (2, 1)}


def test_repair_and_respelling(spark, engine):
    q = spark.createDataFrame([(1, "12A Camp bell Parade", "AU"), (2, "Syd ney", None), (3, "no such", "AU"), (4, "TheRocks Sydney", "AU")], "qid int, q string, country string")
    got = {r.qid: (r.doc_id, r.rest) for r in engine.repair(q).collect()}
    assert got == {1: (2, "campbell parade"), 4: (5, "the rocks sydney")}  # two countries have a Sydney: no answer
    fixed = {r.qid: r.q for r in engine.respell(spark.createDataFrame([(1, "12A Campbel Parade", "AU"), (2, "Sydeny", "AU"), (3, "Sydney", "AU")], "qid int, q string, country string"), 1).collect()}
    assert fixed == {1: "12a campbell parade", 2: "sydney"}
