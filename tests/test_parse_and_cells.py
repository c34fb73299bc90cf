"""Query parsing, sphere cells and simplification by literal cases."""

import numpy as np
import pytest

from geoquill.functions import cells, parse

CASES = [
    ("3/827a Main St, Springvale VIC 3171", "AU", ("827a", "3", "3171", "Victoria", "main street springvale")),
    ("12-14 High Street Sydney", "AU", ("12-14", None, None, None, "high street sydney")),
    ("Unit 5 27 King Rd", "AU", ("27", "5", None, None, "king road")),
    ("100 Broadway #4B New York NY 10005", "US", ("100", "4b", "10005", "New York", "broadway new york")),
    ("10 Downing Street London SW1A 2AA", "GB", ("10", None, "SW1A2AA", None, "downing street london")),
    ("Hauptstrasse 12", "DE", ("12", None, None, None, "hauptstrasse")),
    ("5th Avenue", "US", (None, None, None, None, "5th avenue")),
    ("Sydney", "AU", (None, None, None, None, "sydney")),
]


def test_freeform(spark):
    df = spark.createDataFrame([(k, q, c) for k, (q, c, _) in enumerate(CASES)], "id int, q string, cc string")
    got = {r.id: (r.house, r.unit, r.postcode, r.state, r.rest) for r in parse.freeform(df, "id", "q", "cc").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


@pytest.mark.parametrize(("lat", "lng", "level", "want"), [(0.0, 0.0, 30, "1000000000000001"), (0.0, 0.0, 0, "1"), (0.0, 90.0, 0, "3"), (90.0, 0.0, 0, "5"), (0.0, 180.0, 0, "7"), (-90.0, 0.0, 0, "b")])
def test_cell_tokens(lat, lng, level, want):
    assert cells.token(int(cells.cell_ids(np.array([lat]), np.array([lng]), level)[0])) == want


def test_cells_nest(spark):
    rng = np.random.default_rng(3)
    lat, lng = rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500)
    fine, coarse = cells.cell_ids(lat, lng, 17).view(np.uint64), cells.cell_ids(lat, lng, 10).view(np.uint64)
    low = np.uint64(1 << 40)
    assert ((fine & ~(np.uint64(2) * low - np.uint64(1)) | low) == coarse).all()
    near = cells.cell_ids(lat + 1e-9, lng, 17).view(np.uint64)
    assert (near == fine).mean() > 0.99
    df = spark.createDataFrame([(1, 10.0, 20.0)], "id int, lat double, lng double")
    assert cells.with_cells(df, 10).first().cell == int(cells.cell_ids(np.array([10.0]), np.array([20.0]), 10)[0])


def test_simplify():
    t = np.linspace(0, 2 * np.pi, 400)
    ring = np.column_stack([np.sin(t), np.cos(t)])
    small = cells.simplify_to(ring, 50)
    assert 20 <= len(small) <= 50 and (small[0] == ring[0]).all()
    assert len(cells.simplify(np.array([[0, 0], [0, 1], [0, 2.0]]), 0.01)) == 2
    assert len(cells.simplify(np.zeros((0, 2)), 1.0)) == 0
