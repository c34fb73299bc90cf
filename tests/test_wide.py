"""Date line, holes, cells without rings, files of odd shapes, shards, clusters, spelling and completion against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoquill.functions import geo
from geoquill.functions import text as tx
from geoquill.operators import ladder
from geoquill.operators import relational as rel
from geoquill.operators import search as se
from geoquill.operators import spatial as sp
from geoquill.plans import formats, searching
from geoquill.sources import catalog, ranges, readers, writers
from geoquill.streaming import gates

RING = "array<struct<lat:double,lng:double>>"


def test_rings_across_the_date_line(spark):
    """Both ways to write such a ring: signs that change, and longitudes beyond 180."""
    rings = [(1, [(-1.0, 179.0), (1.0, 179.0), (1.0, -179.0), (-1.0, -179.0)]), (2, [(-1.0, 179.0), (1.0, 179.0), (1.0, 181.0), (-1.0, 181.0)])]
    polygons = spark.createDataFrame(rings, f"id long, ring {RING}")
    points = [(1, 0.0, 180.0, True), (2, 0.0, -179.5, True), (3, 0.0, 179.5, True), (4, 0.0, 0.0, False), (5, 45.0, 180.0, False), (6, 0.0, 178.0, False), (7, 0.0, -178.0, False)]
    q = spark.createDataFrame([p[:3] for p in points], "qid long, lat double, lng double")
    for deg in (0.3, 2.0, 8.0):
        got = {(r.qid, r.id) for r in sp.point_in_polygon(q, polygons, deg).collect()}
        assert got == {(k, i) for k, _, _, inside in points if inside for i in (1, 2)}
    direct = q.crossJoin(polygons).where(geo.in_ring(F.col("ring"), F.col("lat"), F.col("lng"))).select("qid", "id")
    assert {tuple(r) for r in direct.collect()} == got
    assert [round(r[0], 6) for r in polygons.select(geo.ring_area(F.col("ring"))).collect()] == [4.0, 4.0]


def test_segments_and_points_across_the_date_line(spark):
    q = spark.createDataFrame([(1, 0.001, 179.9995), (2, 0.001, -179.9995), (3, 0.0, 0.0)], "qid long, lat double, lng double")
    ways = spark.createDataFrame([(7, "Line", [(0.0, 179.999), (0.0, -179.999)])], f"id long, name string, nodes {RING}")
    got = {r.qid: geo_m(r.d) for r in sp.nearest_way(q, ways, 0.01).collect()}
    assert set(got) == {1, 2} and all(abs(m - 111.19) < 0.1 for m in got.values())
    near = sp.nearest(q.where("qid = 1"), spark.createDataFrame([(1, 0.001, -179.9985)], "id long, lat double, lng double"), 0.01).collect()
    assert len(near) == 1 and abs(geo_m(near[0].d) - 222.4) < 0.5
    whole = sp.segments(ways).first()
    assert abs(whole.total - 222.4) < 0.5


def geo_m(d):
    return math.sqrt(d) * 6_371_000


def _inside(ring, lat, lng):
    out = False
    for (a, b), (c, d) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (a > lat) != (c > lat) and lng < (d - b) * (lat - a) / (c - a) + b:
            out = not out
    return out


@pytest.mark.parametrize("deg", [0.7, 3.0])
def test_ragged_polygons_with_holes(spark, deg):
    rng = random.Random(9)
    star = lambda y, x, r, n: [(y + r * (0.5 + rng.random() / 2) * math.sin(2 * math.pi * k / n), x + r * (0.5 + rng.random() / 2) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    shapes = [(i, star(10 * i, 20 * i, 8, 40), [star(10 * i, 20 * i, 2, 12)] if i % 2 else None) for i in range(4)]
    shapes.append((9, [(1.0, 1.0), (2.0, 2.0)], None))
    polygons = spark.createDataFrame(shapes, f"id long, ring {RING}, holes array<{RING}>")
    points = [(k, rng.uniform(-10, 40), rng.uniform(-10, 70)) for k in range(400)] + [(900 + i, s[1][0][0], s[1][0][1]) for i, s in enumerate(shapes)]
    got = {(r.qid, r.id) for r in sp.point_in_polygon(spark.createDataFrame(points, "qid long, lat double, lng double"), polygons, deg).collect()}
    want = {(k, i) for k, y, x in points for i, ring, holes in shapes if len(ring) > 2 and _inside(ring, y, x) != any(_inside(h, y, x) for h in holes or [])}
    assert got == want and len(got) > 20


def test_distance_without_a_point_is_none(spark):
    row = spark.range(1).select(geo.haversine(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0)).alias("m")).first()
    assert row.m is None


def test_clusters_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.v: r.c for r in rel.clusters(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {v: v for e in edges for v in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == of


def test_spelling_by_deletions_equals_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 10))) for _ in range(150)})
    docs = [(i, w) for k, w in enumerate(words) for i in range(1 + k % 7)]
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 10))) for _ in range(60)})
    got = {r.term: (r.fixed, r.dist) for r in se.correct_spelling(spark.createDataFrame(docs, "doc_id long, term string"), spark.createDataFrame([(t,) for t in terms], "term string"), 2).collect()}
    df = {w: 1 + k % 7 for k, w in enumerate(words)}

    def osa(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    want = {}
    for t in terms:
        most = 2 if len(t) >= 8 else 1
        found = [(osa(t, w), -n, w) for w, n in df.items() if w != t and n >= max(1, df.get(t, 0)) * 2]
        found = sorted(x for x in found if x[0] <= most)
        if found:
            want[t] = (found[0][2], found[0][0])
    assert got == want and len(got) > 10


def test_completion_walks_keys_in_order(spark):
    entries = spark.createDataFrame([("au", f"a{k:03d}", k, f"A{k}", 100 - k) for k in range(50)], "country string, key string, id long, name string, rank int")
    q = spark.createDataFrame([(1, "au", "a"), (2, "au", "a"), (3, "au", "a00"), (4, "nz", "a")], "qid int, country string, prefix string")
    got = {}
    for r in se.prefix_search(entries, q, 2, walk=10).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: [9, 8], 2: [9, 8], 3: [9, 8]}


def test_headers_of_any_order(spark, tmp_path):
    (tmp_path / "us" / "x").mkdir(parents=True)
    (tmp_path / "au").mkdir()
    (tmp_path / "us" / "x" / "a.csv").write_text('street,NUMBER,Lon,lat\n"Main, St",5,1.5,2.5\n"two\nlines",0,1,2\n')
    (tmp_path / "au" / "b.csv").write_text("LON,LAT,NUMBER,STREET,UNIT\n3,4,7,High St,2\nnan,4,8,Bad,\n")
    rows = {r.street: (r.number, r.lon, r.lat, r.unit, r.country_code) for r in readers.open_addresses(spark, str(tmp_path)).collect()}
    assert rows == {"Main, St": ("5", "1.5", "2.5", None, "us"), "two\nlines": ("0", "1", "2", None, "us"), "High St": ("7", "3", "4", "2", "au"), "Bad": ("8", "nan", "4", None, "au")}
    good = readers.usable_addresses(readers.open_addresses(spark, str(tmp_path)))
    assert {(r.street, r.lat, r.lng) for r in good.collect()} == {("Main, St", 2.5, 1.5), ("High St", 4.0, 3.0)}
    assert {r.name for r in catalog.files(spark, str(tmp_path), ".csv").collect()} == {"a.csv", "b.csv"}


def test_pointer_is_replaced_at_once(spark, tmp_path):
    for v in ("v1", "v2"):
        writers.write_index(spark, f"file://{tmp_path}", v, {"t": spark.range(2 if v == "v2" else 1)})
        assert (tmp_path / "current").read_text() == v
    assert writers.open_index(spark, f"file://{tmp_path}")["t"].count() == 2


def test_address_databases():
    entries = [(0x01020300, 24, {"country": {"iso_code": "AU"}}), (0x80000000, 1, {"country": {"iso_code": "ZZ"}, "city": {"names": {"en": "x" * 40}}})]
    for bits in (24, 28, 32):
        for six in (False, True):
            tree = ranges.Tree(formats.address_database(entries, bits, six))
            got = [r for k in range(256) for r in tree.walk(k)]
            assert got == [(0x01020300, 0x010203FF, entries[0][2]), (0x80000000, 0xFFFFFFFF, entries[1][2])]
    with pytest.raises(ValueError):
        ranges.Tree(b"nothing")


def test_reloading_keeps_the_last_table(spark, tmp_path):
    """A failed load leaves what is held; the first one must work."""
    source = str(tmp_path / "in")
    spark.range(4).coalesce(1).write.parquet(source)
    loads, seen = [], []

    def load(marker, table):
        loads.append(marker)
        if len(loads) > 1:
            raise OSError("half written")
        return 1, spark.createDataFrame([(2, "two")], "id long, name string")

    stream = spark.readStream.schema("id long").parquet(source)
    q = gates.reloading(stream, load, lambda b, t: b.join(t, "id"), lambda out, n: seen.extend(r.name for r in out.collect()))
    for _ in range(2):
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        spark.range(2, 4).coalesce(1).write.mode("append").parquet(source)
    assert seen == ["two", "two"] and loads == [None, 1]


def test_grades_and_suffixes(spark):
    docs, _, _ = searching._tables(spark)
    assert docs.where("doc_id = 1").first().alt == ""
    q = spark.createDataFrame([(1, None, None), (2, "", None), (3, " , Australia", None)], "qid long, q string, country string")
    assert {(r.qid, r.q, r.country) for r in ladder.country_suffix(q).collect()} == {(1, None, None), (2, "", None), (3, " , Australia", None)}


def test_house_numbers_without_numbers(spark):
    rows = [("12", "12", True), ("12", "10-14", True), ("14-10", "12", True), ("12a", "12", False), ("12a", "12A", True), ("12a", "10-14", True), ("x", "x", True), ("x", "12", False), ("99999999999", "1", False), ("", "", True), (None, "1", None)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", tx.house_matches(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
