"""Text and geometry functions by literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from geoquill.functions import geo
from geoquill.functions import text as tx


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "stored", "want"),
    [("42", "42", True), ("42", "42A", True), ("42A", "42", False), ("42A", "42B", False), ("42a", "42A", True), ("1327A", "1320-1340", True), ("5", "1-9", True), ("5", "9-1", True), ("10", "1-9", False),
     ("Lot 5", "lot 5", True), ("Lot 5", "5", False), ("4294967296", "1-4294967296", False)],
)
def test_house_matches(spark, query, stored, want):
    assert one(spark, tx.house_matches(F.col("q"), F.col("s")), q=query, s=stored) is want


@pytest.mark.parametrize(
    ("raw", "unit", "number"),
    [("Apt 4 / 12", "Apt 4", "12"), ("Flat 3, 22", "Flat 3", "22"), ("Unit 5/12", "Unit 5", "12"), ("3/827a", "3", "827a"), ("12-14", None, "12-14"), ("12/40-44", "12", "40-44"), ("12, Apt 3", None, "12, Apt 3"), ("", None, None)],
)
def test_split_house(spark, raw, unit, number):
    got = one(spark, tx.split_house(F.col("r")), r=raw)
    assert (got["unit"], got["number"]) == (unit, number)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("12 Main St", "12 main street"), ("St. Kilda", "st kilda"), ("Saint Louis", "st louis"), ("Jackson St SE", "jackson street se"), ("Dr Martin Luther King Jr Blvd", "doctor martin luther king junior boulevard"),
     ("West 37 Street", "west 37th street"), ("Fifth Ave", "5th avenue"), ("Twenty First Street", "21st street"), ("N.Y.C.", "nyc"), ("Mount Isa", "mt isa"), ("7 Street", "7 street"), ("", "")],
)
def test_user_tokens(spark, raw, want):
    df = tx.user_tokens(spark.createDataFrame([(1, raw)], "id int, q string"), "id", "q")
    assert " ".join(df.first()["tokens"]) == want


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [(tx.unit_key, "APT 3B", "3b"), (tx.unit_key, "# 12", "12"), (tx.unit_key, "3B", "3b"), (tx.strip_article, "The Rocks", "Rocks"), (tx.strip_article, "l'Isle", "Isle"), (tx.strip_article, "Them", None),
     (tx.short_form, "Frankfurt am Main", "Frankfurt"), (tx.short_form, "Newcastle-under-Lyme", "Newcastle"), (tx.short_form, "Sydney", None), (tx.title_case, "BAULKHAM HILLS", "Baulkham Hills"),
     (tx.country_label, " AU ", "au"), (tx.country_label, "AUS", "unknown"), (tx.postcode, "sw1a 1aa", "SW1A1AA"), (tx.key, "Saint-Étienne", "st etienne"), (tx.remove_ordinals, "5th and 21ST", "5 and 21"),
     (tx.percent_encode, "a b&c", "a%20b%26c"), (tx.csv_field, 'a"b', '"a""b"')],
)
def test_words(spark, f, raw, want):
    assert one(spark, f(F.col("r")), r=raw) == want


def test_edits(spark):
    near = lambda a, b, k: one(spark, tx.osa_distance(F.col("a"), F.col("b"), k), a=a, b=b)
    assert near("sydney", "sydeny", 1) and not near("sydney", "sydenx", 1) and near("melbourne", "melborune", 1) and near("abcd", "badc", 2)


def test_geometry(spark):
    d = one(spark, geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=-33.8688, b=151.2093, c=-37.8136, d=144.9631)
    assert abs(d - 713_400) < 1000
    v = lambda y, x: F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lng"))
    square = F.array(v(0, 0), v(0, 2), v(2, 2), v(2, 0))
    inside = lambda y, x: spark.range(1).select(geo.in_ring(square, F.lit(float(y)), F.lit(float(x)))).first()[0]
    assert inside(1, 1) and not inside(3, 1) and inside(0, 0) and not inside(2, 2)
    fiji = F.array(v(-20, 178), v(-20, -178), v(-16, -178), v(-16, 178))
    row = spark.range(1).select(geo.ring_area(fiji).alias("a"), geo.centroid(fiji).alias("c")).first()
    assert math.isclose(row["a"], 16) and math.isclose(row["c"]["lat"], -18) and math.isclose(abs(row["c"]["lng"]), 180)
    cells = spark.range(1).select(geo.cells_around(F.lit(0.0), F.lit(179.9), 1.0).alias("n"), geo.cell(F.lit(0.0), F.lit(-179.9), 1.0).alias("c")).first()
    assert cells["c"] in cells["n"] and len(cells["n"]) == 9
    number = lambda s, e, t, k: spark.range(1).select(geo.interpolated_number(F.lit(float(s)), F.lit(float(e)), F.lit(t), F.lit(k))).first()[0]
    assert number(2, 10, 0.5, 2) == 6 and number(10, 2, 0.5, 2) == 10 and number(1, 10, 0.5, 0) == 6
