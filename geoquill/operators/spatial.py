"""Set-oriented spatial joins: every one an equi-join on grid cells with the exact predicate behind it.

Point tables have id, lat, lng; query tables qid, lat, lng; polygon tables id, ring and what the caller adds. Cells bound
what a query sees, so ``deg`` must be at least the largest distance of interest; nothing is paired beyond a cell's
neighbours. Ties go to the smallest id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geoquill.functions import geo


def cell_join(queries: DataFrame, points: DataFrame, deg: float, ring: int = 1) -> DataFrame:
    """All (query, point) pairs in neighbouring cells; point columns other than lat and lng keep their names."""
    q = queries.select("*", F.explode(geo.cells_around(F.col("lat"), F.col("lng"), deg, ring)).alias("_cell"))
    p = points.withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"}).withColumn("_cell", geo.cell(F.col("p_lat"), F.col("p_lng"), deg))
    return q.join(p, "_cell").drop("_cell").withColumn("d", geo.dist_sq(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))


def best(rows: DataFrame, by: list[str], order: list[Column], keep: int = 1, rank: str = "rn") -> DataFrame:
    """Top ``keep`` rows of each group in a total order (a limit Catalyst pushes below the exchange)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= keep)


#: Degrees and cells of a tile, whose points go to one task, at least; points and queries of a tile beyond which it is dealt out.
TILE_DEG, TILE_CELLS, TILE_POINTS, TILE_QUERIES = 16.0, 4, 200_000, 50_000
#: Degrees of a cell beyond which the world has too few to tell one side of a query from the other.
WIDE_DEG = 40.0


def _dealt(q: DataFrame, p: DataFrame, keys: list[str], spot: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_i`` and ``_j``: a tile with many points is cut into parts that every query meets, one with many
    queries into parts that get all points, so no task holds more than a part of each. Crowded tiles alone are counted out
    to all tasks: there are at most as many as the input has such parts."""
    n = lambda side, c: side.groupBy(*keys).agg(F.count("*").alias(c))
    sizes = n(q, "_nq").join(n(p, "_np"), keys).select(*keys, F.ceil(F.col("_np") / TILE_POINTS).cast("int").alias("_ni"), F.ceil(F.col("_nq") / TILE_QUERIES).cast("int").alias("_nj"))
    crowded = F.broadcast(sizes.where("_ni > 1 or _nj > 1"))
    one = F.lit(1)
    last = lambda c: F.sequence(F.lit(0), F.coalesce(c, one) - 1)
    some = lambda c, names: F.pmod(F.xxhash64(*names), F.coalesce(c, one)).cast("int")
    q = q.join(crowded, keys, "left").select(*q.columns, F.explode(last(F.col("_ni"))).alias("_i"), some(F.col("_nj"), ["qid", "lat", "lng"]).alias("_j"))
    p = p.join(crowded, keys, "left").select(*p.columns, some(F.col("_ni"), ["id", *spot]).alias("_i"), F.explode(last(F.col("_nj"))).alias("_j"))
    return q, p


def _met(q: DataFrame, p: DataFrame, keys: list[str], out_q: list[str], out_p: list[str], search, spot: tuple[str, ...] = ("_x0", "_y0")) -> DataFrame:
    """Pairs that ``search(key, left, right)`` finds in each tile: columns ``out_q`` and ``out_p`` of its rows. ``spot``:
    columns of a point that with its id tell where it is dealt to."""
    fresh = lambda side: side.select(*[F.col(c).alias(c) for c in side.columns])
    q, p = _dealt(fresh(q), fresh(p), keys, spot)  # both may come from one table
    keys = [*keys, "_i", "_j"]
    fields = [q.schema[c] for c in out_q] + [p.schema[c] for c in out_p]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def scan(key, left, right):
        import pyarrow as pa

        if left.num_rows and right.num_rows:
            i, o = search(key, left, right)
        else:
            i = o = []
        i, o = pa.array(i, pa.int64()), pa.array(o, pa.int64())
        cols = [left.column(c).take(i) for c in out_q] + [right.column(c).take(o) for c in out_p]
        return pa.table(cols, names=[*out_q, *out_p])

    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(scan, schema)


def _ranks(column):
    """Order of ids as numbers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return np.asarray(pc.rank(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"))


def _same(on: tuple[str, ...]) -> Column:
    return F.xxhash64(*on) if on else F.lit(0).cast("long")


def close_rows(queries: DataFrame, points: DataFrame, deg: float, keep: int = 1, within_m: float | None = None, on: tuple[str, ...] = (), rung: Column | None = None, may: Column | None = None, boxes: tuple[str, str, str, str] | None = None, line: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Of :func:`cell_join` the pairs that can be among the ``keep`` nearest of a query, with the same columns.

    Tiles of cells meet the queries in and next to them; in a tile a packed tree answers each query, so nothing is paired that
    is far behind the nearest. Columns in ``on`` must be equal (by 64 bits of hash). ``rung``: a number of a point, of which a
    query sees only the least that has a point in reach (null: first); ``may``: rungs 0 to 62 that a query takes, as bits.
    ``boxes``: columns of least latitude and longitude, largest latitude and longitude of objects that are no points.
    ``line``: columns of latitude and longitude of the first and last end of objects that are straight; of equal lines the
    first by id and ``seg`` are searched, and distances are those to the line.
    """
    cols, w = round(360 / deg), max(TILE_CELLS, round(TILE_DEG / deg))
    row, col = (lambda c: F.floor((c + 90) / deg)), (lambda c: F.floor((c + 180) / deg))
    real = lambda *names: [F.col(c).isNotNull() & ~F.isnan(c) for c in names]
    q = queries
    for cond in real("lat", "lng"):
        q = q.where(cond)
    across = lambda c: F.floor(F.pmod(c, F.lit(cols)) / w)
    tile = lambda r, c: F.floor(r / w) * (1 << 20) + across(c)
    q = q.withColumns({"_r": row(F.col("lat")), "_c": F.pmod(col(F.col("lng")), F.lit(cols))})
    tiles = F.array_distinct(F.array(*[tile(F.col("_r") + i, F.col("_c") + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    q = q.withColumn("_tile", F.explode(tiles)).drop("_r", "_c")
    kept = list(points.columns) if boxes else ["p_" + c if c in ("lat", "lng") else c for c in points.columns]
    p = points if boxes else points.withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"})
    y0, x0, y1, x1 = boxes or ("p_lat", "p_lng", "p_lat", "p_lng")
    for cond in real(*dict.fromkeys((y0, x0, y1, x1))):
        p = p.where(cond)
    if on:
        q, p = q.withColumn("_on", _same(on)), p.withColumn("_on", _same(on))
    if rung is not None:
        p = p.withColumn("_rung", F.coalesce(rung.cast("long"), F.lit(-(1 << 62))))
    if may is not None:
        q = q.withColumn("_may", may)
        p = p.where(F.col("_rung").between(0, 62)) if rung is not None else p
    if boxes:
        r0, c0, r1, c1 = row(F.col(y0)), col(F.col(x0)), row(F.col(y1)), col(F.col(x1))
        wide = F.array_distinct(F.transform(F.sequence(c0, c1), across))
        down = F.sequence(F.floor(r0 / w), F.floor(r1 / w))
        many = F.flatten(F.transform(down, lambda r: F.transform(wide, lambda c: r * (1 << 20) + c)))
        one = (F.floor(r0 / w) == F.floor(r1 / w)) & (c1 - c0 < w) & (across(c0) == across(c1))
        p = p.withColumn("_tile", F.explode(F.when(one, F.array(tile(r0, c0))).otherwise(many)))
    else:
        p = p.withColumn("_tile", tile(row(F.col("p_lat")), col(F.col("p_lng"))))
    reach = math.inf if within_m is None else math.degrees(within_m / geo.EARTH_M) ** 2 * (1 + 1e-8)
    out_q, out_p = list(queries.columns), [c for c in kept if c not in on]
    point, keyed, graded, limited = boxes is None, bool(on), rung is not None, may is not None

    def search(key, left, right):
        import numpy as np

        from geoquill.operators import proximity

        get = lambda t, c: t.column(c).to_numpy()
        real = lambda t, c: get(t, c).astype(float)
        cell = lambda c, half: np.floor((c + half) / deg).astype(np.int64)
        none = lambda t: np.zeros(t.num_rows, np.int64)
        mid = (key[0].as_py() % (1 << 20)) * w + w // 2
        turn = lambda x: x - 360 * np.round((x - ((mid + 0.5) * deg - 180)) / 360)
        wheel = lambda c: (c - mid + cols // 2) % cols - cols // 2 + mid
        b0, b1 = real(right, x0), real(right, x1)
        a0 = turn(b0)
        lo, hi = np.stack([real(right, y0), a0], 1), np.stack([real(right, y1), a0 + (b1 - b0)], 1)
        c0, c1 = cell(b0, 180), cell(b1, 180)
        cells = np.stack([cell(lo[:, 0], 90), cell(hi[:, 0], 90), wheel(c0), wheel(c0) + c1 - c0], 1)
        lat, lng = real(left, "lat"), real(left, "lng")
        at = np.stack([cell(lat, 90), wheel(cell(lng, 180) % cols)], 1)
        spot = np.stack([lat, turn(lng)], 1)
        scale = np.stack([np.ones(len(lat)), np.cos(np.radians(lat))], 1)
        rank, ends = _ranks(right.column("id")) if point else None, None
        if line:
            ids = _ranks(right.column("id"))
            by = np.lexsort((get(right, "seg"), ids))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            east = real(right, line[1]) == b0
            ends = np.stack([real(right, line[0]), np.where(east, lo[:, 1], hi[:, 1]), real(right, line[2]), np.where(east, hi[:, 1], lo[:, 1])], 1)
        on_q, on_p = (get(left, "_on"), get(right, "_on")) if keyed else (none(left), none(right))
        return proximity.laddered(on_q, on_p, get(right, "_rung") if graded else none(right), get(left, "_may") if limited else None, lo, hi, cells, rank, spot, scale, at, keep, np.full(len(lat), reach), ends=ends)

    return _met(q, p, ["_tile"], out_q, out_p, search, (x0, y0))


def _near(queries: DataFrame, points: DataFrame, deg: float, within_m: float | None, **how) -> DataFrame:
    """:func:`close_rows` with squared distances; cells that are too wide for tiles are joined."""
    if deg > WIDE_DEG and not how.get("on") and how.get("may") is None:
        return cell_join(queries, points, deg)
    rows = close_rows(queries, points, deg, within_m=within_m, **how)
    return rows.withColumn("d", geo.dist_sq(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))


def nearest(queries: DataFrame, points: DataFrame, deg: float, within_m: float | None = None) -> DataFrame:
    """Nearest point of each query, within a radius if given."""
    rows = _near(queries, points, deg, within_m)
    if within_m is not None:
        rows = rows.where(F.col("d") < geo.cutoff(within_m))
    return best(rows, ["qid"], [F.col("d"), F.col("id")]).drop("rn")


def nearest_ranked(queries: DataFrame, points: DataFrame, deg: float, within_m: float | None = None) -> DataFrame:
    """Best rank first, then nearest: places and points of interest."""
    rows = _near(queries, points, deg, within_m, rung=F.col("rank"))
    if within_m is not None:
        rows = rows.where(F.col("d") <= geo.cutoff(within_m))
    return best(rows, ["qid"], [F.col("rank"), F.col("d"), F.col("id")]).drop("rn")


def nearest_on_ladder(queries: DataFrame, points: DataFrame, deg: float, rung: Column, may: Column | None, order: list[Column], on: tuple[str, ...] = (), within_m: float | None = None) -> DataFrame:
    """Nearest point on the first rung that answers. ``order`` ranks what :func:`close_rows` leaves and begins with the rung."""
    rows = _near(queries, points, deg, within_m, rung=rung, may=may, on=on)
    if within_m is not None:
        rows = rows.where(F.col("d") < geo.cutoff(within_m))
    return best(rows, ["qid"], order).drop("rn")


def within_radius(queries: DataFrame, points: DataFrame, deg: float, radius_m: float, keep: int | None, on: tuple[str, ...] = ()) -> DataFrame:
    """Every point within a radius, nearest first, the first ``keep``: a report, so the limit is its feature. Without one
    (None) nothing is ranked. Columns in ``on`` must be equal.

    With a limit cells are searched, each by a packed tree over the unit sphere; without one every pair is wanted and joined."""
    q = queries.select("*", F.explode(geo.cells_in_radius(F.col("lat"), F.col("lng"), deg, radius_m)).alias("_cell"))
    p = points.withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"}).withColumn("_cell", geo.cell(F.col("p_lat"), F.col("p_lng"), deg))
    if keep is None:
        rows = q.join(p, ["_cell", *on]).drop("_cell")
    else:
        out_p = [c for c in p.columns if c not in ("_cell", *on)]
        p = p.where(F.col("p_lat").isNotNull() & F.col("p_lng").isNotNull() & ~F.isnan("p_lat") & ~F.isnan("p_lng"))
        q = q.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")).withColumn("_on", _same(on))
        rows = _met(q, p.withColumns({"_on": _same(on), "_y0": F.col("p_lat"), "_x0": F.col("p_lng")}), ["_cell"], list(queries.columns), out_p, on_sphere(radius_m, keep))
    rows = rows.withColumn("metres", geo.haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))).where(F.col("metres") <= radius_m)
    return rows if keep is None else best(rows, ["qid"], [F.round("metres", 3), F.col("id")], keep)


def radius_links(points: DataFrame, radius_m: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a, b) between ``points`` (id, lat, lng, on) that join what chains of points within a radius of each other join.

    Points of one cell, whose diagonal the radius covers, all lie within it and hang on the least of them. Two cells are
    joined if a point of one has its nearest of the other in the radius: a look-up for each point and cell, not each pair.
    """
    cols = max(6, math.ceil(360 / (0.99 * math.degrees(radius_m / geo.EARTH_M) / math.sqrt(2))))
    deg = 360 / cols
    rows = points.select("id", "lat", "lng", *on, geo.cell(F.col("lat"), F.col("lng"), deg).alias("_cell"))
    rows = rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    for c in on:
        rows = rows.where(F.col(c).isNotNull())
    hubs = rows.groupBy(*on, "_cell").agg(F.min("id").alias("_hub"))
    rows = rows.join(hubs, [*on, "_cell"]).withColumn("_on", _same(on))
    stars = rows.where("id <> _hub").select(F.col("id").alias("a"), F.col("_hub").alias("b"))
    p = rows.select("id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.col("lat").alias("_y0"), F.col("lng").alias("_x0"), "_on", "_cell", F.col("_hub").alias("b"))
    q = rows.select(F.col("id").alias("qid"), "lat", "lng", "_on", F.col("_hub").alias("a"), *on, F.explode(geo.cells_in_radius(F.col("lat"), F.col("lng"), deg, radius_m)).alias("_cell"))
    q = q.join(hubs, [*on, "_cell"]).where("_hub < a")
    met = _met(q, p, ["_cell"], ["a", "lat", "lng"], ["b", "p_lat", "p_lng"], on_sphere(radius_m, 1))
    met = met.where(geo.haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")) <= radius_m)
    return stars.unionByName(met.select("a", "b").distinct())


def on_sphere(radius_m: float, keep: int):
    """The search of :func:`_met` for the ``keep`` nearest by great circles; distances within six millimetres count as ties,
    as they are ranked by the millimetre."""

    def search(key, left, right):
        import numpy as np

        from geoquill.operators import proximity

        def unit(t, a, b):
            y, x = np.radians(t.column(a).to_numpy().astype(float)), np.radians(t.column(b).to_numpy().astype(float))
            return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)

        p, q = unit(right, "p_lat", "p_lng"), unit(left, "lat", "lng")
        reach = 4.0 if radius_m >= math.pi * geo.EARTH_M else (2 * math.sin(radius_m / geo.EARTH_M / 2)) ** 2
        on_p = right.column("_on").to_numpy()
        return proximity.laddered(left.column("_on").to_numpy(), on_p, np.zeros(len(p), np.int64), None, p, p, None, _ranks(right.column("id")), q, None, None, keep, np.full(len(q), reach), 1e-9)

    return search


def _pairs(ways: DataFrame) -> DataFrame:
    """One row per pair of consecutive nodes of ``ways`` (id, nodes): the way's other columns, seg, a_lat, a_lng, b_lat, b_lng."""
    n, k = F.col("nodes"), F.col("seg")
    rows = ways.where((F.size(n) >= 2) & F.forall(n, lambda v: v["lat"].isNotNull() & v["lng"].isNotNull()))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size(n) - 2)).alias("seg"))
    ends = [n[i][c].alias(f"{end}_{c}") for end, i in (("a", k), ("b", k + 1)) for c in ("lat", "lng")]
    return rows.select(*[c for c in ways.columns if c != "nodes"], "seg", *ends)


def segments(ways: DataFrame) -> DataFrame:
    """One row per pair of consecutive nodes of ``ways`` (id, nodes): seg, a_lat, a_lng, b_lat, b_lng, and metres before."""
    rows = _pairs(ways)
    size = geo.haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    before = Window.partitionBy("id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    return rows.withColumn("size", size).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0.0))).withColumn("total", F.sum("size").over(whole))


def nearest_way(queries: DataFrame, ways: DataFrame, deg: float, arc: bool = True) -> DataFrame:
    """Nearest way over its segments: streets and interpolation ways. With ``arc`` the arc position of the foot as ``t``, which
    takes the lengths of all segments."""
    seg = segments(ways) if arc else _pairs(ways)
    far = F.col("a_lng") + geo.half_turn(F.col("b_lng") - F.col("a_lng"))
    seg = seg.withColumns({"_lat0": F.least("a_lat", "b_lat"), "_lng0": F.least(F.col("a_lng"), far), "_lat1": F.greatest("a_lat", "b_lat"), "_lng1": F.greatest(F.col("a_lng"), far)})
    rows = close_rows(queries, seg, deg, boxes=("_lat0", "_lng0", "_lat1", "_lng1"), line=("a_lat", "a_lng", "b_lat", "b_lng")).drop("_lat0", "_lng0", "_lat1", "_lng1")
    at = [F.col(c) for c in ("lat", "lng", "a_lat", "a_lng", "b_lat", "b_lng")]
    rows = rows.withColumn("d", geo.segment_dist_sq(*at)).withColumn("foot", geo.foot_on_segment(*at))
    if arc:
        rows = rows.withColumn("t", F.when(F.col("total") == 0, 0.0).otherwise((F.col("before") + F.col("foot") * F.col("size")) / F.col("total")))
    return best(rows, ["qid"], [F.col("d"), F.col("id"), F.col("seg")]).drop("rn")


def _edge_box(e: Column) -> Column:
    i, j = e["i"], e["j"]
    return F.struct(F.least(i["lat"], j["lat"]).alias("lat0"), F.least(i["lng"], j["lng"]).alias("lng0"), F.greatest(i["lat"], j["lat"]).alias("lat1"), F.greatest(i["lng"], j["lng"]).alias("lng1"))


#: Fixed value: square degrees of a hole below which it is an artefact of mapping.
LEAST_HOLE = 1e-8


def _all_edges(polygons: DataFrame) -> Column:
    """Edges of the ring and of its holes: a ray counts them alike, so a point in a hole is outside."""
    own = geo.ring_edges(geo.unwrapped(F.col("ring")))
    if "holes" not in polygons.columns:
        return own
    real = F.filter(F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType)), lambda h: geo.ring_area(h) >= LEAST_HOLE)
    return F.concat(own, F.flatten(F.transform(real, lambda h: geo.ring_edges(geo.unwrapped(h)))))


def polygon_cells(polygons: DataFrame, deg: float) -> DataFrame:
    """A polygon's cells, without its ring: those that an edge may touch, and the interior ones, which need no test.

    A cell that no edge's box touches lies inside or outside as a whole, as its middle does. ``id`` is unique. A column
    ``holes`` (array of rings), if there is one, is cut out; holes of next to no area are not.
    """
    rows = polygons.withColumn("ring", geo.unwrapped(F.col("ring"))).where(F.size("ring") >= 3)
    rows = rows.withColumn("_edges", _all_edges(polygons)).withColumn("_box", geo.bbox(F.col("ring"))).drop("ring", "holes")
    edge = F.array_distinct(F.flatten(F.transform("_edges", lambda e: geo.cells_of_box(_edge_box(e), deg))))
    rows = rows.withColumn("_edge", edge).withColumn("_rest", F.array_except(geo.cells_of_box(F.col("_box"), deg), "_edge"))

    def inside(c: Column) -> Column:
        lat, lng = geo.cell_centre(c, deg)
        return F.size(F.filter("_edges", lambda e: geo.crosses_ray(e, lat, geo.onto_ring(lng, F.col("_box.lng0"))))) % 2 == 1

    inner = F.filter("_rest", inside)
    one = lambda cells, flag: F.transform(cells, lambda c: F.struct(c.alias("_cell"), F.lit(flag).alias("_interior")))
    both = F.concat(one(F.col("_edge"), False), one(inner, True))
    return rows.select(*[c for c in polygons.columns if c not in ("ring", "holes")], F.inline(both))


def ring_bands(polygons: DataFrame, deg: float) -> DataFrame:
    """(id, _row, edges, west): a ring's edges by the rows of cells that they span. A ray needs no others of its row."""
    rows = polygons.where(F.size("ring") >= 3).select("id", geo.bbox(F.col("ring"))["lng0"].alias("west"), F.explode(_all_edges(polygons)).alias("e"))
    low, high = (f(F.col("e.i.lat"), F.col("e.j.lat")) for f in (F.least, F.greatest))
    rows = rows.withColumn("_row", F.explode(F.sequence(F.floor((low + 90) / deg), F.floor((high + 90) / deg))))
    return rows.groupBy("id", "_row").agg(F.collect_list("e").alias("edges"), F.first("west").alias("west"))


def point_in_polygon(queries: DataFrame, polygons: DataFrame, deg: float, border: float = 0.0) -> DataFrame:
    """All (query, polygon) pairs with the point inside: columns of both, but not the ring.

    Points meet cells, which hold no rings. Interior cells answer at once; a point in another cell meets the edges of its
    polygon that span its row of cells, and counts crossings among those, which is the ray cast over the whole ring. With
    ``border`` points within so many degrees of an edge count too, for a caller that decides them.
    """
    q = queries.withColumn("_cell", geo.cell(F.col("lat"), F.col("lng"), deg))
    met = q.join(polygon_cells(polygons, deg), "_cell").withColumn("_row", F.floor((F.col("lat") + 90) / deg))
    near = met.where("not _interior").join(ring_bands(polygons, deg), ["id", "_row"])
    x = geo.onto_ring(F.col("lng"), F.col("west"))
    inside = F.size(F.filter("edges", lambda e: geo.crosses_ray(e, F.col("lat"), x))) % 2 == 1
    if border:
        inside = inside | F.exists("edges", lambda e: geo.off_edge_sq(e, F.col("lat"), x) <= border * border)
    near = near.where(inside)
    out = [c for c in met.columns if c not in ("_cell", "_row", "_interior")]
    return met.where("_interior").select(*out).unionByName(near.select(*out))


def smallest_by_level(hits: DataFrame) -> DataFrame:
    """Of the polygons around a point the smallest of each level."""
    return best(hits, ["qid", "level"], [F.col("area"), F.col("id")]).drop("rn")


def admin_fields(levels: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per query with the fields that its levels map to.

    ``mapping``: country_code (null: default), level, field, max_area. A country's own entry overrides the default;
    ``ignore`` drops the level; a field ending in _if_empty fills only what no lower level gave, and later levels still
    overwrite. ``levels``: qid, level, name, area, country_code.
    """
    own = mapping.where("country_code is not null").select("country_code", "level", F.col("field").alias("own"), F.col("max_area").alias("own_max"))
    base = mapping.where("country_code is null").select("level", F.col("field").alias("base"), F.col("max_area").alias("base_max"))
    rows = levels.join(own, ["country_code", "level"], "left").join(base, "level", "left")
    rows = rows.select("qid", "level", "name", "area", F.coalesce("own", "base").alias("field"), F.when(F.col("own").isNotNull(), F.col("own_max")).otherwise(F.col("base_max")).alias("cap"))
    rows = rows.where((F.col("field") != "ignore") & (F.col("cap").isNull() | (F.col("area") <= F.col("cap"))))
    out = []
    for f in ("country", "state", "county", "city", "postcode"):
        here = F.col("field") == f
        fill = F.col("field") == f + "_if_empty"
        out.append(F.coalesce(F.max_by("name", F.when(here, F.col("level"))), F.min_by("name", F.when(fill, F.col("level")))).alias(f))
    return rows.groupBy("qid").agg(*out)


#: Countries that write the number first and the state, and those that write the postcode before the city.
NUMBER_FIRST = "US CA AU NZ GB IE ZA IN NG KE GH PK PH TH MY".split()
POSTCODE_FIRST = "JP KR CN TW".split()


def format_address(house: Column, road: Column, city: Column, state: Column, postcode: Column, country: Column, code: Column) -> Column:
    """A display line by country family; null without road, city and country."""
    family = F.when(code.isin(NUMBER_FIRST), 0).when(code.isin(POSTCODE_FIRST), 1).otherwise(2)
    street = F.when(family == 2, F.concat_ws(" ", road, F.when(road.isNotNull(), house))).otherwise(F.concat_ws(" ", F.when(road.isNotNull(), house), road))
    state = F.when(family != 2, state)
    before = F.concat_ws(", ", F.nullif(F.concat_ws(" ", postcode, city), F.lit("")), state)
    after = F.concat_ws(" ", F.nullif(F.concat_ws(", ", city, state), F.lit("")), postcode)
    middle = F.when(family == 0, after).otherwise(before)
    line = F.concat_ws(", ", F.nullif(street, F.lit("")), F.nullif(middle, F.lit("")), country)
    return F.when(road.isNotNull() | city.isNotNull() | country.isNotNull(), F.nullif(line, F.lit("")))
