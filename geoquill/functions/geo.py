"""Geometry as Column functions: distances, segments, rings, grid cells. Degrees in, metres or radians out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would take a null for 1


def half_turn(dlng: Column) -> Column:
    """A difference of longitudes brought within half a turn, so that neighbours across the date line are near."""
    return dlng - 360 * F.round(dlng / 360)


def dist_sq(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared equirectangular distance in square radians, for ranking and cut-offs."""
    dlat, dlng = F.radians(lat1 - lat2), F.radians(half_turn(lng1 - lng2)) * F.cos(F.radians(lat1))
    return dlat * dlat + dlng * dlng


def metres(d: Column) -> Column:
    return F.sqrt(d) * EARTH_M


def cutoff(m: float) -> float:
    """A radius in metres as squared radians."""
    return (m / EARTH_M) ** 2


def foot_on_segment(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """Position 0..1 of the nearest point of a segment, longitudes scaled by the query's latitude; the short way round."""
    k = F.cos(F.radians(lat))
    dx, dy = half_turn(b_lng - a_lng) * k, b_lat - a_lat
    px, py = half_turn(lng - a_lng) * k, lat - a_lat
    n = dx * dx + dy * dy
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / n)))


def segment_dist_sq(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    t = foot_on_segment(lat, lng, a_lat, a_lng, b_lat, b_lng)
    return dist_sq(lat, lng, a_lat + t * (b_lat - a_lat), a_lng + t * half_turn(b_lng - a_lng))


def ring_edges(ring: Column) -> Column:
    """Array of (i, j): every vertex with the one before it, the first with the last."""
    n = F.size(ring)
    return F.zip_with(ring, F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))), lambda i, j: F.struct(i.alias("i"), j.alias("j")))


def crosses_ray(e: Column, lat: Column, lng: Column) -> Column:
    """Whether an edge meets the ray east of a point. Half-open in latitude, so a shared vertex counts once."""
    i, j = e["i"], e["j"]
    at = (j["lng"] - i["lng"]) * (lat - i["lat"]) / F.when(j["lat"] == i["lat"], F.lit(1.0)).otherwise(j["lat"] - i["lat"]) + i["lng"]
    return ((i["lat"] > lat) != (j["lat"] > lat)) & (lng < at)


def off_edge_sq(e: Column, lat: Column, lng: Column) -> Column:
    """Squared distance in degrees of a point from an edge on the plane."""
    i, j = e["i"], e["j"]
    dy, dx = j["lat"] - i["lat"], j["lng"] - i["lng"]
    n = dy * dy + dx * dx
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lat - i["lat"]) * dy + (lng - i["lng"]) * dx) / n)))
    y, x = lat - i["lat"] - t * dy, lng - i["lng"] - t * dx
    return y * y + x * x


def onto_ring(lng: Column, west: Column) -> Column:
    """A longitude in the frame of a ring whose west end is ``west`` and which may go on beyond 180 degrees."""
    return F.when(lng < west, lng + 360).otherwise(lng)


def in_ring(ring: Column, lat: Column, lng: Column) -> Column:
    """Ray cast through an array of (lat, lng), across the date line too; holes bridged into the ring count by parity."""
    whole = unwrapped(ring)
    x = onto_ring(lng, F.array_min(F.transform(whole, lambda v: v["lng"])))
    return (F.size(ring) >= 3) & (F.size(F.filter(ring_edges(whole), lambda e: crosses_ray(e, lat, x))) % 2 == 1)


def unwrapped(ring: Column) -> Column:
    """A ring with an edge of more than half a turn crosses the date line: its western longitudes go on beyond 180."""
    over = F.exists(ring_edges(ring), lambda e: F.abs(e["i"]["lng"] - e["j"]["lng"]) > 180)
    return F.when(over, F.transform(ring, lambda v: F.struct(v["lat"].alias("lat"), F.when(v["lng"] < 0, v["lng"] + 360).otherwise(v["lng"]).alias("lng")))).otherwise(ring)


def _shoelace(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct((a["lng"] * b["lat"] - b["lng"] * a["lat"]).alias("w"), (a["lng"] + b["lng"]).alias("x"), (a["lat"] + b["lat"]).alias("y")))


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def ring_area(ring: Column) -> Column:
    """Area in square degrees, across the date line too."""
    return F.abs(_sum(_shoelace(unwrapped(ring)), lambda e: e["w"])) / 2


def area_km2(ring: Column) -> Column:
    """Area on a local projection about the ring's mean latitude."""
    mean = _sum(ring, lambda v: v["lat"]) / F.size(ring)
    return ring_area(ring) * F.cos(F.radians(mean)) * (111.32**2)


def centroid(ring: Column) -> Column:
    """Area-weighted centroid (lat, lng); the vertex mean where the area vanishes."""
    r = unwrapped(ring)
    e, n = _shoelace(r), F.size(ring)
    w = _sum(e, lambda x: x["w"])
    flat = F.abs(w) < 1e-12
    lat = F.when(flat, _sum(r, lambda v: v["lat"]) / n).otherwise(_sum(e, lambda x: x["y"] * x["w"]) / (3 * w))
    lng = F.when(flat, _sum(r, lambda v: v["lng"]) / n).otherwise(_sum(e, lambda x: x["x"] * x["w"]) / (3 * w))
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def bbox(ring: Column) -> Column:
    """Least and largest latitude and longitude; east of the date line the latter goes on beyond 180."""
    ring = unwrapped(ring)
    lats, lngs = F.transform(ring, lambda v: v["lat"]), F.transform(ring, lambda v: v["lng"])
    return F.struct(F.array_min(lats).alias("lat0"), F.array_min(lngs).alias("lng0"), F.array_max(lats).alias("lat1"), F.array_max(lngs).alias("lng1"))


def cell(lat: Column, lng: Column, deg: float) -> Column:
    """Grid cell number: rows of 2**20 columns, longitudes wrapped."""
    cols = round(360 / deg)
    return F.floor((lat + 90) / deg) * (1 << 20) + F.pmod(F.floor((lng + 180) / deg), F.lit(cols))


def cells_around(lat: Column, lng: Column, deg: float, ring: int = 1) -> Column:
    """The cell of a point and its neighbours, wrapped at the date line, distinct."""
    cols = round(360 / deg)
    row, col = F.floor((lat + 90) / deg), F.floor((lng + 180) / deg)
    return F.array_distinct(F.array(*[(row + i) * (1 << 20) + F.pmod(col + j, F.lit(cols)) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)]))


def cells_in_radius(lat: Column, lng: Column, deg: float, radius_m: float) -> Column:
    """All cells that a circle on the sphere may touch: longitudes widen towards the poles."""
    cols, r = round(360 / deg), radius_m / EARTH_M
    dlat = F.degrees(F.lit(r)) + 1e-9
    near_pole = F.abs(lat) + dlat >= 90
    dlng = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(r)) / F.cos(F.radians(lat))))) + 1e-9)
    rows = F.sequence(F.floor((F.greatest(lat - dlat, F.lit(-90.0)) + 90) / deg), F.floor((F.least(lat + dlat, F.lit(90.0)) + 90) / deg))
    span = F.sequence(F.floor((lng - dlng + 180) / deg), F.floor((lng + dlng + 180) / deg))
    return F.array_distinct(F.flatten(F.transform(rows, lambda a: F.transform(span, lambda c: a * (1 << 20) + F.pmod(c, F.lit(cols))))))


def cell_centre(c: Column, deg: float) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's middle."""
    return (F.floor(c / (1 << 20)) + 0.5) * deg - 90, (F.pmod(c, F.lit(1 << 20)) + 0.5) * deg - 180


def cells_of_box(box: Column, deg: float) -> Column:
    """All cells that a bounding box touches."""
    cols = round(360 / deg)
    rows = F.sequence(F.floor((box["lat0"] + 90) / deg), F.floor((box["lat1"] + 90) / deg))
    span = F.sequence(F.floor((box["lng0"] + 180) / deg), F.floor((box["lng1"] + 180) / deg))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(span, lambda c: r * (1 << 20) + F.pmod(c, F.lit(cols))))))


def bucket(lat: Column, lng: Column, per_degree: float) -> Column:
    """Coarse rounding bucket for signatures, as text."""
    return F.concat_ws(":", F.floor(lat * per_degree + 0.5).cast("long").cast("string"), F.floor(lng * per_degree + 0.5).cast("long").cast("string"))


def interpolated_number(start: Column, end: Column, t: Column, kind: Column) -> Column:
    """House number at arc position t; even and odd ways step by two from the start and never go below it."""
    span = end - start
    plain = F.round(start + t * span).cast("long")
    stepped = (start + F.greatest(F.lit(0.0), F.round(t * span / 2)) * 2).cast("long")
    return F.when(kind == 0, plain).otherwise(stepped)


def importance(population: Column, wikidata: Column, wikipedia: Column) -> Column:
    """0..255 from population (log scale to 100), a wikidata tag (30) and a wikipedia tag (50)."""
    n = F.expr("0") if population is None else population.try_cast("double")
    pop = F.when(n > 0, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log10(n) / 8)) * 100)).otherwise(0)
    return F.least(F.lit(255), F.coalesce(pop, F.lit(0)) + F.when(wikidata, 30).otherwise(0) + F.when(wikipedia, 50).otherwise(0)).cast("int")


def vertex_mean(ring: Column) -> Column:
    """Mean of a ring's vertices (lat, lng), across the date line too."""
    r, n = unwrapped(ring), F.size(ring)
    return F.struct((_sum(r, lambda v: v["lat"]) / n).alias("lat"), half_turn(_sum(r, lambda v: v["lng"]) / n).alias("lng"))


def vertex_cap(level: Column, km2: Column) -> Column:
    """Most vertices of a boundary by level; countries have more the smaller they are."""
    land = F.when(km2 <= 100_000, 32_000).when(km2 <= 500_000, 16_000).otherwise(8_000)
    return F.when(level <= 2, land).when(level <= 4, 3_000).when(level <= 6, 1_500).otherwise(500)
