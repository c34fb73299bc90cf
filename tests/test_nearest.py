"""The search for the nearest in tiles, against brute force, on crowds, on copies and across the date line."""

import math

import numpy as np
import pytest

import __spark_entry__
from geoquill.functions import cells
from geoquill.operators import addresses as adr
from geoquill.operators import relational as rel
from geoquill.operators import search as se
from geoquill.operators import spatial as sp
from pyspark.sql import functions as F


def spots(spark, n, seed, lat=(10.0, 12.0), lng=(178.5, 181.5), key="id"):
    """Random points, half of them copies of others, across the date line."""
    r = np.random.default_rng(seed)
    y, x = r.uniform(*lat, n), r.uniform(*lng, n)
    y[n // 2 :], x[n // 2 :] = y[: n - n // 2], x[: n - n // 2]
    x = (x + 180) % 360 - 180
    rows = [(k, float(a), float(b), int(k * 7 % 3), None if k % 4 else "u") for k, (a, b) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, f"{key} long, lat double, lng double, source int, unit string")


@pytest.fixture(scope="module")
def crowd(spark):
    q = spots(spark, 300, 1, key="qid").select("qid", "lat", "lng")
    return q.cache(), spots(spark, 2_000, 2).cache()


def same(a, b, *cols):
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_nearest_pairs_few_and_is_exact(spark, crowd):
    q, p = crowd
    for deg in (0.25, 1, 20):
        every = sp.cell_join(q, p, deg)
        assert sp.close_rows(q, p, deg).count() < 10 * q.count() < every.count() / 2
        same(sp.nearest(q, p, deg), sp.best(every, ["qid"], [F.col("d"), F.col("id")]), "qid", "id", "d")
    near = sp.cell_join(q, p, 1).where(F.col("d") < sp.geo.cutoff(4000))
    same(sp.nearest(q, p, 1, 4000), sp.best(near, ["qid"], [F.col("d"), F.col("id")]), "qid", "id")


def test_rank_and_ladder_go_before_distance(spark, crowd):
    q, p = crowd
    ranked = p.withColumn("rank", (F.col("id") % 5).cast("int"))
    for within in (None, 9000):
        rows = sp.cell_join(q, ranked, 0.5)
        rows = rows if within is None else rows.where(F.col("d") <= sp.geo.cutoff(within))
        same(sp.nearest_ranked(q, ranked, 0.5, within), sp.best(rows, ["qid"], [F.col("rank"), F.col("d"), F.col("id")]), "qid", "id")
    own = F.when(F.col("qid") % 2 == 0, F.lit(~1)).otherwise(F.lit(-1)).cast("long")
    order = [F.col("source"), F.col("d"), F.col("id")]
    rows = sp.cell_join(q, p, 0.25).where("not (source = 0 and qid % 2 = 0)")
    same(sp.nearest_on_ladder(q, p, 0.25, F.col("source"), own, order), sp.best(rows, ["qid"], order), "qid", "id", "source")


def test_crowded_tiles_are_dealt_out(spark, crowd, monkeypatch):
    q, p = crowd
    want = [tuple(r) for r in sp.nearest(q, p, 1).select("qid", "id").orderBy("qid").collect()]
    monkeypatch.setattr(sp, "TILE_POINTS", 150)
    monkeypatch.setattr(sp, "TILE_QUERIES", 70)
    assert [tuple(r) for r in sp.nearest(q, p, 1).select("qid", "id").orderBy("qid").collect()] == want


def test_first_of_a_radius(spark, crowd):
    q, p = crowd
    every = sp.best(sp.within_radius(q, p, 4, 60_000, None), ["qid"], [F.round("metres", 3), F.col("id")], 7)
    same(sp.within_radius(q, p, 4, 60_000, 7), every, "qid", "id", "rn")
    assert "Join" not in str(sp.within_radius(q, p, 4, 60_000, 7)._jdf.queryExecution().optimizedPlan()).replace("_cell#", "").split("FlatMapCoGroupsInArrow")[0]


def test_nearest_of_ways(spark):
    r = np.random.default_rng(5)
    ways = [(k, [(float(y), float(x)), (float(y + a), float(x + b)), (float(y + a), float(x + 2 * b))]) for k, (y, x, a, b) in enumerate(zip(r.uniform(10, 12, 200), r.uniform(20, 22, 200), r.uniform(-0.3, 0.3, 200), r.uniform(-0.3, 0.3, 200), strict=True))]
    w = spark.createDataFrame(ways, "id long, nodes array<struct<lat double, lng double>>")
    q = spots(spark, 200, 6, lng=(20.0, 22.0), key="qid").select("qid", "lat", "lng")
    at = [F.col(c) for c in ("lat", "lng", "a_lat", "a_lng", "b_lat", "b_lng")]
    every = q.crossJoin(sp.segments(w)).withColumn("d", sp.geo.segment_dist_sq(*at))
    same(sp.nearest_way(q, w, 2), sp.best(every, ["qid"], [F.col("d"), F.col("id"), F.col("seg")]), "qid", "id", "seg")
    seg = sp.segments(w).select("id", F.least("a_lat", "b_lat").alias("y0"), F.least("a_lng", "b_lng").alias("x0"), F.greatest("a_lat", "b_lat").alias("y1"), F.greatest("a_lng", "b_lng").alias("x1"))
    assert sp.close_rows(q, seg, 2, boxes=("y0", "x0", "y1", "x1")).count() < 30 * q.count()


def ranked_rows(monkeypatch):
    """Counts of the rows that are left for the exact ranking."""
    seen, best = [], sp.best
    monkeypatch.setattr(sp, "best", lambda rows, *how: seen.append(rows.count()) or best(rows, *how))
    return seen


def test_copies_of_ways_are_searched_once(spark, monkeypatch):
    r = np.random.default_rng(7)
    at = [(float(y), float(x), float(a), float(b)) for y, x, a, b in zip(r.uniform(10, 12, 60), r.uniform(178, 182, 60), r.uniform(-0.3, 0.3, 60), r.uniform(-0.3, 0.3, 60), strict=True)]
    wrap = lambda x: (x + 180) % 360 - 180
    ways = [(k, [(y, wrap(x)), (y + a, wrap(x + b)), (y + a, wrap(x + b))]) for k, (y, x, a, b) in enumerate(at * 30)]
    w = spark.createDataFrame(ways, "id long, nodes array<struct<lat double, lng double>>")
    q = spots(spark, 200, 8, key="qid").select("qid", "lat", "lng")
    ends = [F.col(c) for c in ("lat", "lng", "a_lat", "a_lng", "b_lat", "b_lng")]
    every = q.crossJoin(sp.segments(w)).withColumn("d", sp.geo.segment_dist_sq(*ends))
    want = sp.best(every, ["qid"], [F.col("d"), F.col("id"), F.col("seg")])
    seen = ranked_rows(monkeypatch)
    same(sp.nearest_way(q, w, 2), want, "qid", "id", "seg")
    assert seen[0] < 3 * q.count()


def test_queries_of_wide_cells_go_to_few_tiles(spark, monkeypatch):
    q = spots(spark, 2_000, 11, (-60.0, 60.0), (-170.0, 170.0), key="qid").select("qid", "lat", "lng").cache()
    p = spots(spark, 1_000, 12, (-60.0, 60.0), (-170.0, 170.0)).withColumn("rank", (F.col("id") % 5).cast("int")).cache()
    want = sp.best(sp.cell_join(q, p, 20), ["qid"], [F.col("rank"), F.col("d"), F.col("id")])
    seen = ranked_rows(monkeypatch)
    same(sp.nearest_ranked(q, p, 20), want, "qid", "id")
    assert seen[0] < 3 * q.count()


def test_addresses_by_number_street_and_unit(spark):
    r = np.random.default_rng(3)
    houses = ["5", "5A", "3-9", "7", "12b", "1-4000", "no number", "9-3"]
    p = [(k, float(y), float(x), houses[k % 8], None if k % 11 == 0 else f"Street {k % 13}", [None, "2", "Unit 3", ""][k % 4], k % 3) for k, (y, x) in enumerate(r.uniform(0, 2, (900, 2)))]
    p = spark.createDataFrame(p, "id long, lat double, lng double, housenumber string, street string, unit string, source int")
    q = [(k, float(y), float(x), ["5", "5a", "4-6", "12", "NO NUMBER", None][k % 6], [None, "Street 1", "street", "Street 12"][k % 4], [None, "3", "2", "99"][k // 2 % 4]) for k, (y, x) in enumerate(r.uniform(0, 2, (240, 2)))]
    q = spark.createDataFrame(q, "qid long, lat double, lng double, q_house string, q_street string, q_unit string")
    rows = sp.cell_join(q, p, 1).where(adr.tx.house_matches(F.col("q_house"), F.col("housenumber")))
    a, b = F.lower("street"), F.lower("q_street")
    rows = rows.where(F.col("q_street").isNull() | F.contains(a, b) | F.contains(b, a)).where("source <> 0 or qid % 2 = 0")
    stored = F.coalesce("unit", F.lit(""))
    tier = F.when(F.col("q_unit").isNull(), stored != "").otherwise(adr.tx.unit_key(stored) != adr.tx.unit_key(F.col("q_unit")))
    want = sp.best(rows, ["qid"], [F.col("source"), tier, F.col("d"), F.col("id")])
    assert want.count() > 100
    same(adr.find_address(q, p, 1, [(0, F.col("qid") % 2 == 0), (1, F.lit(True)), (2, F.lit(True))]), want, "qid", "id")
    assert {c for c, in adr.matching_houses(q, p).select("_house").distinct().collect()} == {"5", "5a", "4-6", "12", "NO NUMBER"}


def test_links_of_a_radius_join_what_pairs_join(spark):
    for lat, lng, r in (((-60.0, 60.0), (-170.0, 170.0), 900_000), ((60.0, 89.0), (100.0, 260.0), 300_000)):
        p = spots(spark, 300, 8, lat, lng).withColumn("pn", F.col("id") % 2)
        pairs = sp.within_radius(p.withColumnRenamed("id", "qid"), p, 15, r, None, ("pn",)).where("qid <> id").select(F.col("qid").alias("a"), F.col("id").alias("b"))
        links = sp.radius_links(p, r, ("pn",))
        same(rel.clusters(links), rel.clusters(pairs), "v", "c")
    crowd = spots(spark, 1_000, 9).withColumn("pn", F.lit(1))
    assert sp.radius_links(crowd, 900_000, ("pn",)).count() < 2_000


def test_simplification_in_one_descent():
    ring = np.random.default_rng(4).random((300, 2))
    weight = cells.weights([ring[:0], ring, ring[:2]])
    assert [len(w) for w in weight] == [0, 300, 2] and np.isinf(weight[1][[0, -1]]).all()
    for eps in (0.0, 0.05, 0.3):
        keep, todo = {0, 299}, [(0, 299)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                p, d = ring[a], ring[b] - ring[a]
                far = [math.dist(x, p + np.clip((x - p) @ d / (d @ d), 0, 1) * d) for x in ring[a + 1 : b]]
                k = int(np.argmax(far))
                if far[k] > eps:
                    keep.add(a + 1 + k)
                    todo += [(a, a + 1 + k), (a + 1 + k, b)]
        assert np.array_equal(ring[sorted(keep)], cells.simplify(ring, eps))
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    circle = np.stack([np.sin(turn), np.cos(turn)], 1)
    assert not cells.crosses_itself(circle, 1000)
    circle[[100, 300]] = circle[[300, 100]]
    assert cells.crosses_itself(circle, 1000) and cells.crosses_itself(circle)


def test_rings_are_dealt_to_all_tasks(spark):
    rows = spark.createDataFrame([(k, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], 3) for k in range(40)], "id long, ring array<struct<lat double, lng double>>, cap int").coalesce(1)
    assert cells.simplified_valid(rows, 60).select(F.spark_partition_id()).distinct().count() > 1


def test_neighbours_at_a_corner_of_the_cube(spark, tmp_path):
    # the coordinates of this customer lie in a cell at a corner of the cube, where seven cells are around it
    near = [k for k in range(1, 3_000_000) if abs(abs(k * 7919 % 120000 / 1000 - 60) - 35.2644) < 0.06 and abs(abs(k * 104729 % 340000 / 1000 - 170) % 90 - 45) < 0.06]
    spark.createDataFrame([(k,) for k in near], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = __spark_entry__.queries()["g10_neighbour_cells"](spark, str(tmp_path)).collect()
    assert len(got) == len(near) > 0 and all(r.n == 8 and r.mutual for r in got)


def test_borders_of_diamonds(spark, tmp_path):
    spark.createDataFrame([(k, f"N{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    keys, want = [], set()
    for k in range(2_040_000):
        y, x = float(k * 7919 % 120000) / 1000 - 60, float(k * 104729 % 340000) / 1000 - 170
        n = int((y + 60) // 24) * 5 + int((x + 170) // 68)
        side = abs(y - (-60 + 24 * (n // 5)) - 12) / 12 + abs(x - (-170 + 68.0 * (n % 5)) - 34) / 34
        if abs(side - 1) < 1e-9 or k < 200:
            keys.append((k,))
            if side < 1:
                want.add((k, n))
    assert len(keys) > 200
    spark.createDataFrame(keys, "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    assert {(r.qid, r.id) for r in __spark_entry__.queries()["j12_country_by_ring"](spark, str(tmp_path)).collect()} == want


def test_all_countries_and_all_keys(spark):
    e = [("a", f"pa{k:05}", k, f"n{k % 7}", 9 if k < 12_000 else 1) for k in range(12_010)] + [("b", "pax", 5, "m", 1), ("b", "q", 6, "m", 0)]
    e = spark.createDataFrame(e, "country string, key string, id long, name string, rank int")
    q = spark.createDataFrame([(1, "pa"), (2, "q"), (3, "zz"), (4, "pa"), (5, "")], "qid long, prefix string")
    got = {}
    for r in se.search_any(e, q, 3).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.id, r.country))
    first = sorted((k % 7, k) for k in range(12_000, 12_010))
    pa = [(5, "b")] + [(k, "a") for _, k in first[:2]]
    assert got == {1: pa, 4: pa, 2: [(6, "b")], 5: [(6, "b"), *pa[:2]]}


def test_spelling_lists_no_rare_words(spark):
    df = spark.createDataFrame([("the", 100), ("thee", 3), ("hte", 1)], "term string, df long")
    asked = spark.createDataFrame([("hte",), ("teh",)], "term string")
    got = {(r.term, r.fixed, r.dist) for r in se.correct_spelling(df, asked, 20).collect()}
    assert got == {("hte", "the", 1), ("teh", "the", 1)}
