"""Masks as row spans and the holes of masks, against plain Python."""

import random

from hypothesis import HealthCheck, given
from hypothesis import settings as limits
from hypothesis import strategies as st

from rillflow.operators import contours, rasters, spans
from rillflow.plans.lattice import GRID

CELLS = "grid_id int, site int, row int, col int"
SPANS = "grid_id int, site int, row int, first int, last int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cells_of(df):
    return {(g, s, r, c) for g, s, r, a, z in rows(df.select("grid_id", "site", "row", "first", "last")) for c in range(a, z + 1)}


def test_cells_and_back(spark):
    cells = [(0, 0, 1, 3), (0, 0, 1, 4), (0, 0, 1, 4), (0, 0, 1, 6), (0, 1, 1, 5), (1, 0, 1, 5), (0, 0, -2, -1), (0, 0, None, 1), (0, 0, 1, None)]
    made = spans.from_cells(spark.createDataFrame(cells, CELLS))
    assert rows(made) == [(0, 0, -2, -1, -1), (0, 0, 1, 3, 4), (0, 0, 1, 6, 6), (0, 1, 1, 5, 5), (1, 0, 1, 5, 5)]
    assert rows(spans.to_cells(made)) == sorted({c for c in cells if None not in c})
    empty = spark.createDataFrame([], CELLS)
    assert not rows(spans.from_cells(empty)) and not rows(spans.union(spans.from_cells(empty), spans.from_cells(empty)))


def test_merging_repeats_and_touches(spark):
    given_spans = [(0, 0, 0, 0, 9), (0, 0, 0, 2, 3), (0, 0, 0, 10, 12), (0, 0, 0, 14, 14), (0, 0, 0, 14, 14), (0, 0, 0, 20, 19), (0, 0, 1, 13, 13)]
    assert rows(spans.merged(spark.createDataFrame(given_spans, SPANS))) == [(0, 0, 0, 0, 12), (0, 0, 0, 14, 14), (0, 0, 1, 13, 13)]


SOME = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 1), st.integers(-5, 150), st.integers(0, 80)), max_size=12)


@limits(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(SOME, SOME)
def test_set_operations_against_sets_of_cells(spark, a, b):
    frames = [spans.merged(spark.createDataFrame([(g, s, r, f, f + n) for g, s, r, f, n in x], SPANS)) for x in (a, b)]
    x, y = (cells_of(f) for f in frames)
    assert cells_of(spans.union(*frames)) == x | y
    assert cells_of(spans.intersection(*frames)) == x & y
    assert cells_of(spans.difference(*frames)) == x - y
    shared = {}
    for g, s, r, c in x:
        for t in (0, 1):
            if (g, t, r, c) in y:
                shared[g, s, t] = shared.get((g, s, t), 0) + 1
    met = {(r.grid_id, r.site_a, r.site_b): r for r in spans.overlap(*frames).collect()}
    assert {k: r.shared for k, r in met.items()} == shared
    for (g, s, t), r in met.items():
        n = len({c for c in x if c[:2] == (g, s)}) + len({c for c in y if c[:2] == (g, t)})
        assert abs(r.iou - r.shared / (n - r.shared)) < 1e-12


def test_large_masks_need_few_rows(spark):
    """Two masks of a million cells overlap by two thousand spans."""
    a, b = (spark.range(1000).selectExpr("0 AS grid_id", "0 AS site", "cast(id as int) AS row", f"{k} AS first", f"{k + 999} AS last") for k in (0, 500))
    (made,) = spans.overlap(a, b).collect()
    assert (made.shared, made.iou) == (500_000, 500_000 / 1_500_000)
    (size,) = spans.sizes(a, GRID).collect()
    assert size.cells == 1_000_000 and size.area_m2 > 9e7


def test_overlap_keeps_grids_apart(spark):
    a = spark.createDataFrame([(0, 1, 0, 0), (1, 1, 5, 5)], CELLS)
    b = spark.createDataFrame([(0, 2, 5, 5), (1, 3, 5, 5)], CELLS)
    assert rows(rasters.overlap(a, b).select("grid_id", "site_a", "site_b", "shared")) == [(1, 1, 3, 1)]


def _reached(cells, start, steps):
    seen, todo = {start}, [start]
    while todo:
        r, c = todo.pop()
        for a, b in steps:
            n = (r + a, c + b)
            if n in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def test_hole_owners_on_nested_and_neighbouring_masks(spark):
    """Rings within rings, holes that see each other along a row, and random masks, against flood fills."""
    rng = random.Random(5)
    nested = {(r, c) for r in range(13) for c in range(13) if max(abs(r - 6), abs(c - 6)) % 2 == 0 and (r, c) != (6, 6)}
    beside = {(r, c) for r in range(3) for c in range(9) if not (r == 1 and c % 2 == 1)} | {(r, c) for r in range(4, 8) for c in range(9) if (r, c) not in {(5, 1), (6, 3), (5, 5), (6, 5), (5, 7)}}
    masks = [nested, beside, *({(r, c) for r in range(14) for c in range(14) if rng.random() < p} for p in (0.55, 0.7, 0.85))]
    df = spark.createDataFrame([(k % 2, k, r, c) for k, m in enumerate(masks) for r, c in m], CELLS)
    ringed = contours.rings(df, 14)
    found = {(r.site, r.ring): r.owner for r in contours.hole_owners(ringed).collect()}
    side = lambda cell, k: 4 * (cell[0] * 14 + cell[1]) + k
    want = {}
    for k, mask in enumerate(masks):
        gaps = {(r, c) for r in range(-1, 15) for c in range(-1, 15)} - mask
        four = ((-1, 0), (0, 1), (1, 0), (0, -1))
        left = set(mask)
        while left:
            ground = _reached(mask, min(left), four)
            left -= ground
            first = min(ground)
            facing = {}
            for r, c in ground:
                for s, (a, b) in enumerate(four):
                    if (r + a, c + b) in gaps:
                        gap = frozenset(_reached(gaps, (r + a, c + b), [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]))
                        facing[gap] = min(facing.get(gap, 1 << 30), side((r, c), s))
            outer = next(g for g in facing if (first[0], first[1] - 1) in g)
            want |= {(k, ring): facing[outer] for g, ring in facing.items() if g is not outer}
    assert found == want and len(want) > 20
