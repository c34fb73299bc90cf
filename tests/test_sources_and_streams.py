"""Readers, writers and keyed stream state on small files."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from geoquill.sources import readers, writers
from geoquill.streaming import gates


def test_readers(spark, tmp_path):
    (tmp_path / "AU").mkdir()
    (tmp_path / "AU" / "x.csv").write_text('LON,LAT,NUMBER,STREET,UNIT,CITY,DISTRICT,REGION,POSTCODE,ID,HASH\n151.2,-33.8,1,"A ""B""\nSt",,Sydney,,,2000,,\n0,0,2,C,,,,,,,\nx,1,3,D,,,,,,,\n1,1,0,E,,,,,,,\n')
    rows = readers.open_addresses(spark, f"file:{tmp_path}")
    assert rows.count() == 4 and {r.country_code for r in rows.collect()} == {"au"}
    assert [r.street for r in readers.usable_addresses(rows).collect()] == ['A "B"\nSt']
    assert readers.open_addresses(spark, f"file:{tmp_path}", skip=["au"]).count() == 0
    (tmp_path / "a.psv").write_text("PID|RETIRED|NAME\n1||Bondi\n2|2020|Gone\n")
    assert [r.name for r in readers.psv(spark, str(tmp_path / "a.psv"), ["pid", "retired", "name"]).where("retired is null").collect()] == ["Bondi"]
    (tmp_path / "p.tsv").write_text("#v1\nAU\t2000\n")
    assert readers.tsv(spark, str(tmp_path / "p.tsv"), "cc string, pc string", "v1").first().pc == "2000"
    with pytest.raises(ValueError):
        readers.tsv(spark, str(tmp_path / "p.tsv"), "cc string, pc string", "v2")
    with gzip.open(tmp_path / "f.geojson.gz", "wt") as f:
        for xy, n in (([151.0, -33.0], "5"), ([0, 0], "6"), ([1, 1], "0")):
            f.write(json.dumps({"type": "Feature", "properties": {"number": n, "street": "S"}, "geometry": {"type": "Point", "coordinates": xy}}) + "\n")
    assert [(r.number, r.lat) for r in readers.point_features(spark, str(tmp_path / "f.geojson.gz")).collect()] == [("5", -33.0)]
    (tmp_path / "m.json").write_text(json.dumps({"defaults": {"admin": {"2": "country"}}, "countries": {"AU": {"admin": {"9": {"field": "city", "max_area": 0.05}, "6": "county"}}}}))
    got = {tuple(r) for r in readers.admin_mapping(spark, str(tmp_path / "m.json")).collect()}
    assert got == {(None, 2, "country", None), ("AU", 9, "city", 0.05), ("AU", 6, "county", None)}
    body = json.dumps({"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 1], [2, 3], [4, 5], [0, 1]]], [[[9, 9], [8, 8], [7, 7], [9, 9]]]]}})
    rings = spark.range(1).select(readers.rings(F.lit(body)).alias("r")).first().r
    assert len(rings) == 2 and rings[0][1].lat == 3 and rings[0][1].lng == 2
    ip = spark.range(1).select(readers.ip_number(F.lit("1.2.3.4")).alias("a"), readers.ip_number(F.lit("1.2.3.400")).alias("b")).first()
    assert ip.a == 16909060 and ip.b is None
    state = spark.range(1).select(readers.replication_state(F.lit("sequenceNumber=12\ntimestamp=2024-02-29T10\\:11\\:12Z")).alias("s")).first().s
    assert state.sequence == 12 and state.timestamp.minute == 11
    assert readers.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_index_is_published_last(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("cc"))
    root = f"file:{tmp_path}/index"
    writers.write_index(spark, root, "v1", {"t": df}, {"t": ["cc"]})
    assert writers.open_index(spark, root)["t"].count() == 10
    writers.write_index(spark, root, "v2", {"t": df.limit(3)}, cluster={"t": "cc"})
    assert writers.open_index(spark, root)["t"].count() == 3
    writers.dump_csv(spark.createDataFrame([(1, 1.5, 'a"b')], "id int, lat double, name string").coalesce(1), f"file:{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text == 'id,lat,name\n1,1.500000,"a""b"\n'
    writers.export_tsv(spark.createDataFrame([("AU", "2000")], "a string, b string").coalesce(1), f"file:{tmp_path}/tsv", "v1")
    assert sorted(x for p in (tmp_path / "tsv").glob("part-*") for x in p.read_text().splitlines()) == ["#v1", "AU\t2000"]
    assert writers.summary({"t": df}).first()["rows"] == 10
    assert writers.response(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"]).first().body == '{"a":1}'


def _stream(spark, tmp_path, rows):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for n, part in enumerate(rows):
        df = spark.createDataFrame([(e, k, t0 + dt.timedelta(seconds=s)) for e, k, s in part], "event_id long, k string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{n}"))
    return spark.readStream.schema("event_id long, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def _drain(df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_throttle_restarts_at_the_last_event_let_through(spark, tmp_path):
    s = _stream(spark, tmp_path, [[(1, "a", 0), (2, "a", 20), (3, "a", 31), (4, "b", 5)], [(5, "a", 55), (6, "a", 61), (7, "b", 40)]])
    got = {r.event_id for r in _drain(gates.throttle(s, "k", "ts", 30), tmp_path, "throttled").collect()}
    assert got == {1, 3, 6, 4, 7}


def test_token_bucket(spark, tmp_path):
    s = _stream(spark, tmp_path, [[(1, "a", 0), (2, "a", 0), (3, "a", 0)], [(4, "a", 1), (5, "a", 1), (6, "a", 100)]])
    got = {r.event_id: r.sent for r in _drain(gates.token_bucket(s, "k", "ts", 1.0, 2.0), tmp_path, "bucket").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
