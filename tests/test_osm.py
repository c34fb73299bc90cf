"""The exchange format's reader on a file made here."""

import struct
import zlib

from geoquill.sources import osm


def _v(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _z(n):
    return _v((n << 1) ^ (n >> 63))


def _f(k, x):
    return _v(k << 3) + _v(x) if isinstance(x, int) else _v(k << 3 | 2) + _v(len(x)) + x


def _deltas(xs):
    return b"".join(_z(b - a) for a, b in zip([0, *xs], xs, strict=False))


def _blob(kind, data, press=True):
    blob = _f(2, len(data)) + _f(3, zlib.compress(data)) if press else _f(1, data)
    head = _f(1, kind) + _f(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def test_read(spark, tmp_path):
    words = [b"", b"name", b"Bondi", b"highway", b"residential", b"outer"]
    table = _f(1, b"".join(_f(1, w) for w in words))
    dense = _f(1, _deltas([10, 12, 11])) + _f(8, _deltas([-339000000, -338000000, -337000000])) + _f(9, _deltas([1512000000, 1513000000, 1511000000])) + _f(10, b"".join(map(_v, [1, 2, 0, 0, 0])))
    way = _f(1, 77) + _f(2, _v(3)) + _f(3, _v(4)) + _f(8, _deltas([10, 11, 12]))
    short = _f(1, 78) + _f(8, _deltas([10, 99]))
    rel = _f(1, 5) + _f(8, _v(5)) + _f(9, _deltas([77])) + _f(10, _v(1))
    plain = _f(1, (9 << 1)) + _f(8, (2 * 10_000_000 << 1)) + _f(9, (-3 * 10_000_000 << 1) ^ -1)
    path = tmp_path / "x.pbf"
    path.write_bytes(_blob(b"OSMHeader", b"") + _blob(b"OSMData", table + _f(2, _f(2, dense))) + _blob(b"OSMData", table + _f(2, _f(3, way) + _f(3, short) + _f(4, rel) + _f(1, plain)), False))
    rows = {(r.kind, r.id): r for r in osm.read(spark, [str(path)]).collect()}
    assert len(rows) == 7
    n = rows["node", 10]
    assert (round(n.lat, 7), round(n.lng, 7), n.tags) == (-33.9, 151.2, {"name": "Bondi"}) and rows["node", 11].tags == {}
    assert (round(rows["node", 9].lat, 7), round(rows["node", 9].lng, 7)) == (2.0, -3.0)
    assert rows["way", 77].refs == [10, 11, 12] and rows["way", 77].tags == {"highway": "residential"}
    assert [(m.kind, m.ref, m.role) for m in rows["relation", 5].members] == [("way", 77, "outer")]
    whole = osm.ways_with_nodes(osm.read(spark, [str(path)])).collect()
    assert [w.id for w in whole] == [77] and [round(v.lng, 1) for v in whole[0].nodes] == [151.2, 151.1, 151.3]
    assert osm.read(spark, [str(path), str(path)]).count() == 14
    assert osm.packed(_v(300) + _v(1)).tolist() == [300, 1] and osm.packed(_z(-5) + _z(7), True).tolist() == [-5, 7]
