"""Registered queries answer for all rows and whole texts of their tables."""

import math

import pytest

import __spark_entry__
from geoquill.operators.spatial import within_radius


def run(spark, name, sf):
    return __spark_entry__.queries()[name](spark, str(sf))


def test_whole_texts(spark, tmp_path):
    head = "plain words " * 10
    rows = [(1, head + "Mount Évora, St"), (2, head + 'said "no"'), (3, head + "straße\nend"), (4, "short"), (5, head)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda name, c: {r.doc_id: r[c] for r in run(spark, name, tmp_path).collect()}
    assert got("x01_fold", "folded") == {1: head + "Mount Evora, St", 2: head + 'said "no"', 3: head + "strasse\nend", 4: "short", 5: head}
    assert got("x01_fold", "n")[3] == len(head) + 11
    assert got("x02_key", "key") == {1: head + "mt evora st", 2: head + "said no", 3: head + "strasse end", 4: "short", 5: head.strip()}
    assert got("x19_locality", "locality")[1] == head + "mount evora st"
    assert got("x30_escapes", "csv") == {1: f'"{rows[0][1]}"', 2: f'"{head}said ""no"""', 3: f'"{rows[2][1]}"', 4: "short", 5: head}


def test_bm25_covers_all_documents(spark, tmp_path):
    texts = {1: "the thing", 2: "the other", 3: "les eaux", 4: "que para the thing", 5: "nothing here", 6: "the thing the thing", 7: "eaux"}
    rows = [(k, f"s{k % 2}", v) for k, v in texts.items()]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    terms, want = {1: ["the", "thing"], 2: ["les", "eaux"], 3: ["que", "para"]}, {}
    for source in ("s0", "s1"):
        own = {d: v.split() for d, s, v in rows if s == source}
        mean = sum(map(len, own.values())) / len(own)
        for q, asked in terms.items():
            for d, w in own.items():
                df = {x: sum(x in y for y in own.values()) for x in asked}
                parts = [math.log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in asked if x in w]
                if parts:
                    want[q, source, d] = (sum(parts), len(parts))
    got = {(r.qid, r.source, r.doc_id): (r.score, r.hit_terms) for r in run(spark, "a14_bm25", tmp_path).collect()}
    assert got.keys() == want.keys() and {d for _, _, d in got} == {1, 2, 3, 4, 6, 7}
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-4) and got[k][1] == want[k][1] for k in want)
    best = {(r.qid, r.doc_id) for r in run(spark, "t06_merged_top", tmp_path).collect()}
    assert best == {(q, d) for (q, _, d), (_, n) in want.items() if n == 2}


@pytest.fixture(scope="module")
def geo_tables(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("geo")
    tables = {
        "customer": ("c_custkey long", [(c,) for c in range(1, 9)]),
        "orders": ("o_orderkey long, o_custkey long", [(c + 90, c) for c in range(1, 9)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(s, f"S{s}", s % 2) for s in range(1, 41)]),
        "nation": ("n_nationkey long, n_name string", [(0, "N0"), (1, "N1")]),
        "part": ("p_partkey long, p_name string, p_size int", [(1, "P1", 1), (2, "P2", 50), (103, "P103", 7)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double", [(91, 1, 1, 1, 1.0), (91, 2, 2, 4, 50.0), (92, 1, 103, 3, 45.0)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(sf / f"{name}.parquet"))
    return sf


def test_every_address_and_coordinate_is_answered(spark, geo_tables):
    assert {(r.qid, r.id) for r in run(spark, "j09_house_lookup", geo_tables).collect()} == {(c, c + 90) for c in range(1, 9)}
    assert {(r.qid, r.verdict) for r in run(spark, "r30_validate", geo_tables).collect()} == {(c + 90, "verified") for c in range(1, 9)}
    got = {(r.id, r.variant): r.q for r in run(spark, "r34_query_variants", geo_tables).collect()}
    assert got.keys() == {(c + 90, v) for c in range(1, 9) for v in ("freeform", "abbreviation", "typo")}
    assert [got[92, v] for v in ("freeform", "abbreviation", "typo")] == ["3 Street 2", "3 St 2", "3 Srteet 2"]


def test_nearby_of_every_coordinate(spark, geo_tables):
    at = lambda k, a=0, b=0: ((k * 7919 + a) % 120000 / 1000 - 60, (k * 104729 + b) % 340000 / 1000 - 170)

    def metres(p, q):
        (a, b), (c, d) = ([math.radians(x) for x in y] for y in (p, q))
        return 2 * 6371000.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = set()
    for c in range(1, 9):
        near = sorted((round(m, 3), s) for s in range(1, 41) if (m := metres(at(c), at(s, 311, 977))) <= 1_500_000)[:5]
        want |= {(c, s, k) for k, (_, s) in enumerate(near, 1)}
    assert want and {(r.qid, r.id, r.pos) for r in run(spark, "r23_nearby", geo_tables).collect()} == want


def test_joins_take_all_rows(spark, geo_tables):
    got = {tuple(r) for r in run(spark, "j16_star_join", geo_tables).collect()}
    assert got == {(91, 1, "P1", "S1", "N1"), (91, 2, "P2", "S4", "N0"), (92, 1, "P103", "S3", "N1")}
    assert {tuple(r) for r in run(spark, "j31_alias_tokens", geo_tables).collect()} == {(1, 1), (2, 2), (103, 3)}


def test_radius_without_limit(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 5)], "qid int, lat double, lng double, rank int")
    p = spark.createDataFrame([(k, 0.001 * k, 0.0, 5 + k % 2) for k in range(1, 9)], "id int, lat double, lng double, rank int")
    rows = within_radius(q, p, 4, 200_000, None, ("rank",))
    assert {r.id for r in rows.collect()} == {2, 4, 6, 8}
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
