"""Cells of the sphere by a cube projection with quadratic warp and a Hilbert curve, and line simplification; with numpy.

Cell ids follow the public description of the hierarchy: three face bits, two bits a level along the curve, and a
trailing one. They are held as signed 64-bit numbers: equality is safe, order is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_LEVEL = 30
#: Curve tables: position of quadrant (i, j) and its successor orientation, made from the rule of the Hilbert curve.
_SWAP, _INVERT = 1, 2
_POS_TO_IJ = [[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]]
_IJ_TO_POS = [[row.index(k) for k in range(4)] for row in _POS_TO_IJ]
_TURN = [_SWAP, 0, 0, _INVERT | _SWAP]


def _face_uv(x, y, z):
    a = np.abs(np.stack([x, y, z]))
    face = a.argmax(0)
    v = np.choose(face, [x, y, z])
    face = np.where(v < 0, face + 3, face)
    u = np.select([face == k for k in range(6)], [y / x, -x / y, -x / z, z / x, z / y, -y / z])
    w = np.select([face == k for k in range(6)], [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    return face, u, w


def _st(u):
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * u), 1 - 0.5 * np.sqrt(np.maximum(0, 1 - 3 * u)))


def cell_ids(lat: np.ndarray, lng: np.ndarray, level: int = MAX_LEVEL) -> np.ndarray:
    """Ids of the cells of ``level`` that hold the points."""
    la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        face, u, v = _face_uv(np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la))
    top = 1 << MAX_LEVEL
    i = np.clip(np.floor(_st(u) * top), 0, top - 1).astype(np.uint64)
    j = np.clip(np.floor(_st(v) * top), 0, top - 1).astype(np.uint64)
    turn = np.where(face & 1, _SWAP, 0)
    to_pos, after = np.array(_IJ_TO_POS), np.array(_TURN)
    out = face.astype(np.uint64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        ij = ((((i >> np.uint64(k)) & np.uint64(1)) << np.uint64(1)) | ((j >> np.uint64(k)) & np.uint64(1))).astype(int)
        pos = to_pos[turn, ij]
        out = (out << np.uint64(2)) | pos.astype(np.uint64)
        turn = turn ^ after[pos]
    out = (out << np.uint64(1)) | np.uint64(1)
    low = np.uint64(1 << (2 * (MAX_LEVEL - level)))
    return ((out & ~(np.uint64(2) * low - np.uint64(1))) | low).view(np.int64)


def with_cells(points: DataFrame, level: int, name: str = "cell") -> DataFrame:
    """``points`` (lat, lng) with their cell ids, by Arrow batches."""
    points = points.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = cell_ids(b["lat"].to_numpy(float), b["lng"].to_numpy(float), level)
            yield b

    return points.mapInPandas(scan, f"{fields}, {name} long")


def token(cell: int) -> str:
    """Hexadecimal form without trailing zeros."""
    return f"{cell & (2**64 - 1):016x}".rstrip("0") or "X"


def weights(rings: list[np.ndarray]) -> list[np.ndarray]:
    """For each vertex (lat, lng) the squared tolerance in degrees up to which the Douglas-Peucker rule keeps it; infinite at
    the ends. The farthest vertex of a stretch does not depend on the tolerance, so one descent serves all; that of all rings
    goes on together."""
    size = np.array([len(r) for r in rings], np.int64)
    end = np.cumsum(size)
    out = np.zeros(int(size.sum()))
    real = size > 0
    out[(end - size)[real]] = out[(end - 1)[real]] = np.inf
    flat = np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in rings]) if rings else np.zeros((0, 2))
    a, b = (end - size)[size > 2], (end - 1)[size > 2]
    above = np.full(len(a), np.inf)
    while len(a):
        n = b - a - 1
        head = np.cumsum(n) - n
        own = np.repeat(np.arange(len(a)), n)
        at = np.arange(int(n.sum())) - head[own] + a[own] + 1
        d = flat[b] - flat[a]
        length, rel = (d * d).sum(1), flat[at] - flat[a][own]
        t = np.clip((rel * d[own]).sum(1) / np.where(length > 0, length, 1.0)[own], 0, 1)
        far = ((rel - np.where(length > 0, 1.0, 0.0)[own][:, None] * t[:, None] * d[own]) ** 2).sum(1)
        most = np.maximum.reduceat(far, head)
        first = np.minimum.reduceat(np.where(far == most[own], at, len(flat)), head)
        above = np.minimum(above, most)
        out[first] = above
        a, b, above = np.r_[a, first], np.r_[first, b], np.r_[above, above]
        go = b - a >= 2
        a, b, above = a[go], b[go], above[go]
    return np.split(out, end[:-1]) if rings else []


def simplify(ring: np.ndarray, eps: float) -> np.ndarray:
    """Vertices (lat, lng) that stay within ``eps`` degrees by the Douglas-Peucker rule; the ends stay."""
    return ring[weights([ring])[0] > eps * eps] if len(ring) else ring


def simplify_to(ring: np.ndarray, most: int, rounds: int = 24, weight: np.ndarray | None = None) -> np.ndarray:
    """At most ``most`` vertices: the tolerance is found by bisection; short rings stay as they are. ``weight``: as
    :func:`weights` gives it."""
    if len(ring) <= most:
        return ring
    weight = weights([ring])[0] if weight is None else weight
    order = np.sort(weight)
    lo, hi, best = 0.0, float(np.ptp(ring, 0).max()) or 1.0, None
    for _ in range(rounds):
        mid = (lo + hi) / 2
        n = len(order) - int(order.searchsorted(mid * mid, "right"))
        if n > most:
            lo = mid
        else:
            hi, best = mid, mid if n >= 3 else best
    return ring[[0, len(ring) // 2, -1]] if best is None else ring[weight > best * best]


def simplified(polygons: DataFrame, most: int) -> DataFrame:
    """``polygons`` with rings of at most ``most`` vertices; one ring at a time, no grouping."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polygons.schema)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ring"] = [[{"lat": float(y), "lng": float(x)} for y, x in simplify_to(np.array([(v["lat"], v["lng"]) for v in r]), most)] for r in b["ring"]]
            yield b

    return polygons.mapInPandas(scan, fields)


def _uv(s):
    """The projected coordinate of a warped one, also beyond the face's edge."""
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) * (1 - s)) / 3)


def _degrees(face, u, v):
    """Latitude and longitude of a point on the plane of a face."""
    one = np.ones_like(u)
    x = np.choose(face, [one, -u, -u, -one, v, v])
    y = np.choose(face, [u, one, -v, -v, -one, u])
    z = np.choose(face, [v, v, one, -u, -u, -one])
    return np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x))


def around(lat: np.ndarray, lng: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Middles (lat, lng) of the eight cells of ``level`` around each point's own, a row a point; at a corner of the cube two
    of them are one."""
    la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        face, u, v = _face_uv(np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la))
    size = 2.0**-level
    s, t = ((np.floor(_st(x) / size) + 0.5) * size for x in (u, v))
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    spots = [_degrees(face, _uv(s + i * size), _uv(t + j * size)) for i, j in steps]
    return np.stack([a for a, _ in spots], 1), np.stack([b for _, b in spots], 1)


def neighbours(lat: np.ndarray, lng: np.ndarray, level: int) -> np.ndarray:
    """Ids of the eight cells around each point's own, across faces too."""
    y, x = around(lat, lng, level)
    return cell_ids(y.ravel(), x.ravel(), level).reshape(y.shape)


def crosses_itself(ring: np.ndarray, block: int = 1 << 16) -> bool:
    """Whether two edges of a closed ring that are not neighbours meet. Edges are taken against all others, as many at a time
    as make ``block`` pairs: memory stays linear."""
    a, b = ring, np.roll(ring, -1, 0)
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    n = len(ring)
    step = max(1, block // max(n, 1))
    for k in range(0, n - 2, step):
        i, j = np.arange(k, min(k + step, n - 2))[:, None], np.arange(k + 2, n)[None]
        p, q, c, d = a[i], b[i], a[j], b[j]
        split = lambda u, v: ((u <= 0) & (v >= 0)) | ((u >= 0) & (v <= 0))
        if (split(turn(p, q, c), turn(p, q, d)) & split(turn(c, d, p), turn(c, d, q)) & (j >= i + 2) & ((i > 0) | (j < n - 1))).any():
            return True
    return False


def simplify_valid(ring: np.ndarray, cap: int, most: int, weight: np.ndarray | None = None) -> np.ndarray:
    """A ring of about ``cap`` vertices that does not cross itself; the cap doubles up to ``most`` until one does not. If all
    do, the first is kept."""
    first = simplify_to(ring, cap, weight=weight)
    out = first
    while len(out) >= 4 and crosses_itself(out):
        if cap >= min(len(ring), most):
            return first
        cap = min(cap * 2, most)
        out = simplify_to(ring, cap, weight=weight)
    return out


def simplified_valid(polygons: DataFrame, most: int) -> DataFrame:
    """``polygons`` (id, ring, cap) with their rings simplified to their caps, by Arrow batches. Rings are dealt to all tasks
    first, as their table may be one small file."""
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    polygons = polygons.repartition(tasks, "id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polygons.schema)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rings = [np.array([(v["lat"], v["lng"]) for v in r], float) for r in b["ring"]]
            done = [simplify_valid(r, int(c), most, w) for r, c, w in zip(rings, b["cap"], weights(rings), strict=True)]
            yield b.assign(ring=[[{"lat": float(y), "lng": float(x)} for y, x in r] for r in done])

    return polygons.mapInPandas(scan, fields)
