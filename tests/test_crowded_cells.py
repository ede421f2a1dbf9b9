"""Pairs of paths equal all pairs: with a piece that crosses the whole area, and with half of all rows in one cell."""

import math
import random

import pytest

from kerbline.operators import spatial

SCHEMA = "{} long, path array<struct<x: double, y: double>>"


def distance(p, q):
    def to_piece(c, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((c[0] - a[0]) * dx + (c[1] - a[1]) * dy) / n))
        return math.hypot(c[0] - a[0] - t * dx, c[1] - a[1] - t * dy)

    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    best = math.inf
    for a, b in zip(p, p[1:]):
        for c, d in zip(q, q[1:]):
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return 0.0
            best = min(best, to_piece(a, c, d), to_piece(b, c, d), to_piece(c, a, b), to_piece(d, a, b))
    return best


def paths(rng, n, wide, centre, short):
    return [[(x, y), (x + rng.uniform(-short, short), y + rng.uniform(-short, short))] for x, y in ((centre + rng.uniform(-wide, wide), centre + rng.uniform(-wide, wide)) for _ in range(n))]


@pytest.mark.parametrize("crowded", [20, 1_000_000])
def test_pairs_equal_all_pairs(spark, crowded):
    rng = random.Random(11)
    diagonal = [[(0.0, 0.0), (70_000.0, 70_010.0)]]
    left = diagonal + paths(rng, 60, 20.0, 30_025.0, 8.0) + paths(rng, 60, 3_000.0, 30_000.0, 120.0)
    right = diagonal + paths(rng, 60, 20.0, 30_025.0, 8.0) + paths(rng, 60, 3_000.0, 30_000.0, 120.0)
    odd = [[], [(float("nan"), 0.0), (1.0, 1.0)], [(float("inf"), 0.0), (1.0, 1.0)], None]
    a, b = spark.createDataFrame([*enumerate(left + odd)], SCHEMA.format("l")), spark.createDataFrame([*enumerate(right + odd)], SCHEMA.format("r"))
    found = spatial.near_pairs(a, b, "l", "r", 5.0, crowded=crowded).collect()
    want = {(i, j): d for i, p in enumerate(left) for j, q in enumerate(right) if (d := distance(p, q)) <= 5.0}
    assert len(found) == len(want) > 300
    for r in found:
        assert r["distance"] == pytest.approx(want[r["l"], r["r"]], abs=1e-6)


def test_a_long_piece_is_listed_where_it_runs(spark):
    one = spark.createDataFrame([(1, [(0.0, 0.0), (70_000.0, 70_000.0)])], SCHEMA.format("k"))
    cells = spatial._pieces(one, "k", "l", 10.0, 50.0).select("i", "j").distinct().count()
    assert 1_400 <= cells <= 5 * 1_403  # a part's box, grown, touches its own cell and those beside it


def test_split_cells_test_fewer_pairs(spark):
    rng = random.Random(5)
    both = [spark.createDataFrame([*enumerate(paths(rng, 300, 24.0, 25.0, 0.5))], SCHEMA.format(k)) for k in "lr"]
    coarse, fine = (spatial._pieces(both[0], "l", "l", 1.0, s).join(spatial._pieces(both[1], "r", "r", 0.0, s), ["i", "j"]).count() for s in (50.0, 3.125))
    assert fine * 10 < coarse
    whole, split = ({tuple(r) for r in spatial.near_pairs(*both, "l", "r", 1.0, crowded=n).collect()} for n in (10**9, 1_000))
    assert whole == split and whole
