"""Drainage operators against plain walks on small surfaces."""

import heapq
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.errors import AnalysisError
from rillflow.functions.projection import Grid, LocalFrame
from rillflow.operators import contours, focal, graph, hydrology, imagery, siting
from rillflow.operators.quantiles import quantiles
from rillflow.plans import ensemble, terrain

FRAME = LocalFrame(8.3, 46.25)
EPS = 1e-4


def grid(nx, res=10.0, **more):
    return Grid(FRAME, res, nx, **more)


def lattice(spark, z):
    ny, nx = z.shape
    rows = [(0, r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(ny) for c in range(nx)]
    return spark.createDataFrame(rows, "grid_id int, row int, col int, z double")


def rough(seed, ny=24, nx=27, gaps=True):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 12, (ny, nx)).astype(float) + np.arange(ny)[:, None] * 0.2
    if gaps:
        z[rng.random(z.shape) < 0.04] = np.nan
    return z


def plain_fill(z, eps=EPS):
    """A flood from the rim by rising level."""
    ny, nx = z.shape
    ok = ~np.isnan(z)
    out, done, heap = z.copy(), ~ok, []
    around = lambda r, c: [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for r, c in zip(*np.nonzero(ok), strict=True):
        if any(not (0 <= i < ny and 0 <= j < nx) or not ok[i, j] for i, j in around(r, c)):
            heapq.heappush(heap, (z[r, c], r, c))
            done[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        for i, j in around(r, c):
            if 0 <= i < ny and 0 <= j < nx and not done[i, j]:
                done[i, j] = True
                out[i, j] = max(z[i, j], level + eps)
                heapq.heappush(heap, (out[i, j], i, j))
    return out


@pytest.mark.parametrize("tile", [128, 7])
def test_fill_equals_a_flood(spark, tile):
    z = rough(1)
    got = {(r.row, r.col): r.filled for r in graph.fill_depressions(lattice(spark, z), tile=tile).collect()}
    want = plain_fill(z)
    assert got == {(r, c): want[r, c] for r, c in zip(*np.nonzero(~np.isnan(z)), strict=True)}


def test_plane_drains_east_and_accumulates(spark):
    z = 100 - 0.05 * np.arange(15)[None, :] * 10 + np.zeros((12, 1))
    flow = focal.steepest_descent(lattice(spark, z), 15, 10.0)
    assert {(r.receiver or r.cell + 1) - r.cell for r in flow.where("col < 14").collect()} == {1}
    assert flow.where("receiver is null").count() == 12
    total = graph.accumulate(flow).collect()
    assert all(r.accumulation == r.cell % 15 + 1 for r in total)
    slope = focal.horn_slope(lattice(spark, z), 10.0).where("row between 1 and 10 and col between 1 and 13")
    assert slope.where("abs(slope - 0.05) > 1e-9").count() == 0


def test_every_receiver_is_lower_and_basins_tile_the_map(spark):
    z = rough(2)
    filled = graph.fill_depressions(lattice(spark, z))
    dense = lattice(spark, z).join(filled.select("grid_id", "row", "col", "filled"), ["grid_id", "row", "col"], "left")
    flow = focal.steepest_descent(dense, 27, 10.0, "filled")
    lower = flow.select("receiver", F.col("filled").alias("high")).join(flow.select(F.col("cell").alias("receiver"), F.col("filled").alias("low")), "receiver")
    assert lower.where("low >= high").count() == 0
    rim = hydrology.touches_gap(lattice(spark, z)).select("row", "col")
    assert flow.where("receiver is null").join(rim, ["row", "col"], "left_anti").count() == 0
    sizes = graph.drain(flow).groupBy("root").count().agg(F.sum("count")).first()[0]
    assert sizes == int((~np.isnan(z)).sum())


def test_valley_catchment(spark):
    row, col = np.mgrid[0:40, 0:41]
    z = 0.05 * abs(col - 20) * 10 + 0.01 * row * 10
    flow = focal.steepest_descent(lattice(spark, z), 41, 10.0)
    outlet = spark.createDataFrame([(0, 10 * 41 + 20)], "grid_id int, cell long")
    members = graph.upstream(flow, outlet, 41)
    cells = members.join(flow.select("grid_id", "cell", "row", "col"), ["grid_id", "cell"])
    assert cells.where("row < 10").count() == 0 and cells.count() >= 29 * 41
    summary = siting.catchment_summary(members, lattice(spark, z), grid(41)).first()
    assert summary.cells == cells.count() and summary.lower_bound
    assert summary.length_m == pytest.approx(max((r.straight + r.diagonal * math.sqrt(2)) * 10 for r in members.collect()))


def test_nested_outlets_each_have_all_that_drains_through_them(spark):
    """Two flow graphs side by side; every cell is an outlet, so all but the sources lie below others."""
    rng, n_cols = np.random.default_rng(4), 20
    links = {(g, c): (None if c < 3 else int(rng.integers(max(0, c - 40), c))) for g in (0, 7) for c in range(900 if g else 300)}
    flow = spark.createDataFrame([(g, c, r) for (g, c), r in links.items()], "grid_id int, cell long, receiver long")
    want = set()
    for (g, c), _ in links.items():
        at, straight, diagonal = c, 0, 0
        while True:
            want.add((g, c, at, straight, diagonal))
            below = links[g, at]
            if below is None:
                break
            across = at // n_cols != below // n_cols and at % n_cols != below % n_cols
            straight, diagonal, at = straight + (not across), diagonal + across, below
    toured = graph.tour(flow, n_cols)
    got = graph.members_of(toured, flow.select("grid_id", "cell"))
    assert {tuple(r) for r in got.select("grid_id", "cell", "outlet", "straight", "diagonal").collect()} == want and got.count() == len(want)
    # the ways of the water are the same walks, whichever outlets lie between
    starts = [(g, c, o) for g, c, o, *_ in sorted(want) if (c * 7 + o) % 11 == 0]
    chosen = {}
    for g, c, o in starts:
        chosen.setdefault((g, o), c)
    ways = graph.flow_paths(toured, spark.createDataFrame([(g, o, c) for (g, o), c in chosen.items()], "grid_id int, outlet long, cell long"))
    expected = set()
    for (g, o), c in chosen.items():
        at, step = c, 0
        while True:
            expected.add((g, o, step, at))
            if at == o:
                break
            at, step = links[g, at], step + 1
    assert {(r.grid_id, r.outlet, r.step, r.cell) for r in ways.collect()} == expected and len(expected) > 500


def test_reaches_end_at_confluences(spark):
    links = {1: 2, 2: 3, 3: 7, 4: 5, 5: 3, 7: 8, 8: 9, 9: None, 20: 21, 21: None, 30: None}
    flow = spark.createDataFrame([(0, c, r) for c, r in links.items()], "grid_id int, cell long, receiver long")
    got = {}
    for r in graph.reaches(flow, flow.select("grid_id", "cell")).orderBy("step").collect():
        got.setdefault(r.head, []).append(r.cell)
    assert got == {1: [1, 2, 3], 4: [4, 5, 3], 3: [3, 7, 8, 9], 20: [20, 21]}


def pool(z, start, level):
    seen, todo = set(), [start] if z[start] <= level else []
    while todo:
        r, c = todo.pop()
        if (r, c) in seen:
            continue
        seen.add((r, c))
        todo += [(i, j) for i in (r - 1, r, r + 1) for j in (c - 1, c, c + 1) if 0 <= i < z.shape[0] and 0 <= j < z.shape[1] and z[i, j] <= level]
    return seen


def test_stage_storage_equals_one_flood_per_stage(spark):
    z = rough(3, 12, 13, gaps=False)
    g = grid(13)
    cells = [(0, 45, r * 13 + c) for r in range(12) for c in range(13)]
    members = spark.createDataFrame(cells, "grid_id int, outlet long, cell long")
    filled = lattice(spark, z).withColumn("filled", F.col("z"))
    got = {r.step: r for r in hydrology.stage_storage(members, filled, g, 6.0).collect()}
    area = [100 * math.cos(math.radians(46.25 + r * 10 / 110540)) / math.cos(math.radians(46.25)) for r in range(12)]
    start = (45 // 13, 45 % 13)
    for k, stage in enumerate(hydrology.stages(6.0)):
        wet = pool(z, start, z[start] + stage)
        assert got[k].area_m2 == pytest.approx(sum(area[r] for r, _ in wet))
        assert got[k].volume_m3 == pytest.approx(sum(area[r] * (z[start] + stage - z[r, c]) for r, c in wet))


def test_spill_is_the_step_before_the_jump(spark):
    areas = [10, 20, 40, 50, 400, 500]
    curve = spark.createDataFrame([(0, 1, k, k * 0.5, float(a), float(a * k)) for k, a in enumerate(areas)], "grid_id int, outlet long, step int, stage_m double, area_m2 double, volume_m3 double")
    row = hydrology.spill(curve, 5.0).first()
    assert (row.spill_step, row.usable_m2, row.usable_m3, row.capacity_m3) == (3, 50.0, 150.0, 2500.0)
    assert hydrology.spill(curve, 30.0).first().spill_step is None


def test_hollow_is_the_raised_ground(spark):
    z = np.full((7, 7), 5.0)
    z[2:5, 2:5] = 3.0
    filled = graph.fill_depressions(lattice(spark, z), epsilon=0.0)
    rows = hydrology.hollows(filled, grid(7)).collect()
    assert len(rows) == 9 and {r.hollow for r in rows} == {16}
    assert rows[0].hollow_m3 == pytest.approx(2 * rows[0].hollow_m2)


def test_distance_to_edge_is_exact_up_to_the_cap(spark):
    z = rough(4)
    got = {(r.row, r.col): r.edge_m for r in focal.distance_to_edge(lattice(spark, z), 10.0, 60.0).where("z is not null").collect()}
    ny, nx = z.shape
    gaps = [(r, c) for r in range(-1, ny + 1) for c in range(-1, nx + 1) if not (0 <= r < ny and 0 <= c < nx) or np.isnan(z[r, c])]
    for (r, c), d in got.items():
        assert d == pytest.approx(min(60.0, 10 * min(math.hypot(r - a, c - b) for a, b in gaps)))


def test_sites_leave_out_what_lies_upstream_of_a_pick(spark):
    z = rough(5, gaps=False)
    flow = focal.steepest_descent(lattice(spark, plain_fill(z)), 27, 10.0)
    total = graph.accumulate(flow)
    receiver = {r.cell: r.receiver for r in flow.collect()}
    acc = {r.cell: r.accumulation for r in total.collect()}
    pool_, picks, claimed = sorted((c for c in acc if acc[c] >= 3 and c % 3), key=lambda c: (-acc[c], c)), [], set()

    def below(c):
        while c is not None:
            yield c
            c = receiver[c]

    for c in pool_:
        if c not in claimed and len(picks) < 5:
            picks.append(c)
            claimed |= {x for x in acc if c in below(x)}
    candidates = total.where("accumulation >= 3 and cell % 3 <> 0")
    got = [r.cell for r in siting.choose_sites(flow, candidates, 5).orderBy("rank").collect()]
    assert got == picks


def test_why_no_site(spark):
    cells = spark.createDataFrame([(0, True, False, True, True), (1, True, True, True, False), (1, False, True, True, True), (2, True, True, True, True), (3, False, True, True, True)], "grid_id int, stream boolean, buildable boolean, clear boolean, available boolean")
    assert {r.grid_id: r.code for r in siting.why_none(cells).collect()} == {0: "no_buildable_ground", 1: "no_site_found", 2: None, 3: "no_stream_network"}


def test_cone_gives_one_closed_circle_per_level(spark):
    ny, nx = 40, 50
    row, col = np.mgrid[0:ny, 0:nx]
    z = np.hypot(col - nx / 2, row - ny / 2)
    lines = contours.contours(lattice(spark, z), grid(nx, interval_m=5.0), 5.0).where("level in (5, 10, 15)").collect()
    assert sorted(r.level for r in lines) == [5, 10, 15] and all(r.closed for r in lines)
    for r in lines:
        radii = [math.hypot(p.x - nx / 2, p.y - ny / 2) for p in r.points]
        assert max(abs(x - r.level) for x in radii) < 0.1


def test_chains_are_ordered_from_their_ends_or_smallest_cells(spark):
    rng = np.random.default_rng(12)
    links, want = [], set()
    for g, sizes in ((0, (1, 2, 3, 50, 300, 7)), (5, (1, 1, 64, 65, 2, 9))):
        names = rng.permutation(int(sum(sizes)) * 2)
        at = 0
        for n, closed in zip(sizes, (False, True, True, False, True, False), strict=True):
            cells = [int(c) for c in names[at : at + n]]
            at += n
            low = cells.index(min(cells))
            for i, c in enumerate(cells):
                links.append((g, c, cells[(i + 1) % n] if closed or i + 1 < n else None))
                want.add((g, c, min(cells), (i - low) % n if closed else i, closed))
    for at_once in (1, 2, 3):
        got = graph.chains(spark.createDataFrame(links, "grid_id int, cell long, receiver long"), at_once)
        assert {(r.grid_id, r.cell, r.chain, r.step, r.closed) for r in got.collect()} == want


def test_lines_are_walks_with_high_ground_on_their_left(spark):
    z = rough(9)
    both = lattice(spark, z).union(lattice(spark, z[::-1].copy()).withColumn("grid_id", F.lit(3)))
    levels = both.groupBy("grid_id").agg(F.array(F.lit(3.3), F.lit(6.6), F.lit(9.9)).alias("levels"))
    segments = contours.crossings(both, levels, 27).collect()
    after, before, place = {}, {}, {}
    for s in segments:
        assert after.setdefault((s.grid_id, s.level, s.id_a), s.id_b) == s.id_b and before.setdefault((s.grid_id, s.level, s.id_b), s.id_a) == s.id_a
        place[s.grid_id, s.level, s.id_a], place[s.grid_id, s.level, s.id_b] = (s.ax, s.ay), (s.bx, s.by)
        # the corner just left of the middle of a segment that joins two neighbouring sides
        surface = z if s.grid_id == 0 else z[::-1]
        mx, my, dx, dy = (s.ax + s.bx) / 2, (s.ay + s.by) / 2, s.bx - s.ax, s.by - s.ay
        corners = [(c, r) for c in (math.floor(min(mx, 25.999)), math.floor(min(mx, 25.999)) + 1) for r in (math.floor(min(my, 22.999)), math.floor(min(my, 22.999)) + 1)]
        sides = {(c, r): dx * (r - s.ay) - dy * (c - s.ax) for c, r in corners}
        left, right = [surface[r, c] for (c, r), k in sides.items() if k > 1e-9], [surface[r, c] for (c, r), k in sides.items() if k < -1e-9]
        assert not left or not right or max(left) >= s.level or min(right) < s.level
    want = set()
    for key in place:
        g, level, joint = key
        if key in before:
            ring = [joint]
            while (g, level, ring[-1]) in after and after[g, level, ring[-1]] != joint:
                ring.append(after[g, level, ring[-1]])
            if (g, level, ring[-1]) in after and joint == min(ring):
                want.add((g, level, joint, True, tuple(place[g, level, j] for j in [*ring, joint])))
            continue
        line = [joint]
        while (g, level, line[-1]) in after:
            line.append(after[g, level, line[-1]])
        want.add((g, level, min(line), False, tuple(place[g, level, j] for j in line)))
    got = contours.level_lines(contours.crossings(both, levels, 27)).collect()
    assert len(got) == len(want) and {(r.grid_id, r.level, r.line, r.closed, tuple((p.x, p.y) for p in r.points)) for r in got} == want
    again = contours.contours(both, grid(27), 3.3).where("level < 10").collect()
    assert sorted(sum(math.dist(a, b) for a, b in zip(r.points[:-1], r.points[1:], strict=True)) for r in again) == pytest.approx(sorted(sum(math.dist(a, b) for a, b in zip(r.points[:-1], r.points[1:], strict=True)) for r in got))


def test_every_crossing_is_in_one_line(spark):
    z = rough(6)
    g = grid(27)
    levels = lattice(spark, z).groupBy("grid_id").agg(F.array(F.lit(3.3), F.lit(7.7)).alias("levels"))
    segments = contours.crossings(lattice(spark, z), levels, 27)
    lines = contours.contours(lattice(spark, z), g, 3.3).where("level < 3.4").agg(F.sum(F.size("points") - 1)).first()[0]
    assert segments.where("level = 3.3").count() == lines


def test_mask_outline_keeps_area_and_winding(spark):
    mask = np.zeros((8, 9), bool)
    mask[1:7, 1:8] = True
    mask[3:5, 3:5] = False
    mask[6, 8] = mask[0, 0] = True
    members = spark.createDataFrame([(0, 1, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)], "grid_id int, site long, row int, col int")
    rings = contours.rings(members, 9).collect()
    assert sum(r.area2 for r in rings) == 2 * mask.sum()
    assert sorted(r.area2 for r in rings)[0] == -8 and len(rings) == 3
    shape = contours.mask_geojson(members, grid(9)).first().geometry
    made = json.loads(shape)
    assert made["type"] == "MultiPolygon" and [len(p) for p in made["coordinates"]] == [2, 1]
    assert all(ring[0] == ring[-1] for polygon in made["coordinates"] for ring in polygon)


def test_only_masks_over_budget_are_thinned_again(spark):
    def jagged(n, height):
        return [(float(k), height * (k % 2)) for k in range(n)] + [(float(n), -50.0), (0.0, -50.0), (0.0, 0.0)]

    rows = [(0, 1, 1, jagged(6, 1.0)), (0, 2, 1, jagged(60, 30.0)), (0, 2, 2, jagged(40, 30.0)), (0, 3, 1, jagged(90, 0.1))]
    ringed = spark.createDataFrame(rows, "grid_id int, site int, ring long, points array<struct<x: double, y: double>>")
    got = {(r.site, r.ring): (len(r.thin), r.over) for r in contours.within_budget(ringed, 0.75, 30).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (3, 1)} and not any(over for _, over in got.values())
    assert got[1, 1][0] == 7 and got[2, 1][0] + got[2, 2][0] <= 30 and got[3, 1][0] <= 10
    few = {(r.site, r.ring): (len(r.thin), r.over) for r in contours.within_budget(ringed, 0.75, 30, 2).collect()}
    assert few[1, 1] == got[1, 1] and few[3, 1] == got[3, 1]
    assert few[2, 1][1] and few[2, 2][1] and few[2, 1][0] + few[2, 2][0] > 30


def test_more_levels_than_the_limit_are_refused(spark):
    z = np.array([[0.0, 401.5], [0.0, 401.5]])
    with pytest.raises(AnalysisError) as refused:
        contours.contours(lattice(spark, z), grid(2), 1.0)
    assert refused.value.code == "invalid_interval" and "401 lines" in refused.value.detail and refused.value.hint.startswith("Ask for 2.5 m")
    kept = contours.contours(lattice(spark, z - 1.0), grid(2), 1.0, max_levels=401)
    assert kept.select("level").distinct().count() == 401


def test_extremes_of_a_grid_need_no_single_task(spark):
    z = np.array([[2.0, np.nan, 5.0], [4.0, 1.0, 3.0], [6.0, 7.0, 8.0]])
    both = lattice(spark, z).union(lattice(spark, z + 10).withColumn("grid_id", F.lit(None).cast("int")))
    made = focal.hillshade(both, 10.0)
    windows = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and not any("min(" in x for x in windows)
    got = {(r.grid_id, r.row, r.col): r.shade for r in made.collect()}
    filled = {(r.row, r.col): r.shade for r in focal.hillshade(lattice(spark, np.where(np.isnan(z), 1.0, z)), 10.0).collect()}
    assert len(got) == 18 and all(got[g, *k] == pytest.approx(v) for k, v in filled.items() for g in (0, None))
    ring = lattice(spark, z).withColumn("m", (F.col("row") != 1) | (F.col("col") != 1))
    closed = imagery.fill_holes(ring, 3, "m")
    assert "Window" not in closed._jdf.queryExecution().optimizedPlan().toString() and closed.where("m").count() == 9


def test_an_ensemble_is_its_grids_one_by_one(spark):
    """Grids of three spacings in one pass give what each gives alone, pits filled."""
    z = rough(8, 22, 19, gaps=False)
    z[5, 6] = np.nan
    base, surface = grid(19), lattice(spark, z).drop("grid_id")
    grids = ensemble.spacings(base, 22, (10.0, 12.5, 17.0))
    assert [(g.n_rows, g.n_cols) for g in grids] == [(22, 19), (17, 15), (13, 11)]
    points = [(i, 8.3 + x / FRAME.metres_per_lon, 46.25 + y / FRAME.metres_per_lat) for i, (x, y) in enumerate(((5, 5), (90, 100), (175, 12), (60, 205)))]
    pts = spark.createDataFrame(points, "point_id int, lon double, lat double")
    routed = ensemble.route(surface, base, grids)
    got = {(r.point_id, r.grid_id): r for r in ensemble.delineate(routed, pts, 40.0).collect()}
    inside = {(r.grid_id, r.outlet): r.n for r in ensemble.members(routed, ensemble.delineate(routed, pts, 40.0)).groupBy("grid_id", "outlet").agg(F.count("*").alias("n")).collect()}
    for g in grids:
        alone = Grid(FRAME, g.resolution_m, g.n_cols)
        d = terrain.route(ensemble.sample(surface, base, [g]), alone)
        at = pts.select(F.lit(g.grid_id).alias("grid_id"), "point_id", alone.row(FRAME.y(F.col("lat"))).alias("row"), alone.col(FRAME.x(F.col("lon"))).alias("col"))
        for r in siting.snap(d.cells, at, alone, 40.0).collect():
            mine = got[r.point_id, g.grid_id]
            assert (mine.outlet, mine.accumulation) == (r.row * g.n_cols + r.col, r.accumulation) and mine.moved_m == pytest.approx(r.moved_m)
            assert inside[g.grid_id, mine.outlet] == r.accumulation
    areas = {p: [got[p, g.grid_id].area_m2 for g in grids] for p, *_ in points}
    for r in ensemble.summarise(ensemble.delineate(routed, pts, 40.0)).collect():
        assert r.n_grids == 3 and r.area_m2 == areas[r.point_id][0] and r.mean_m2 == pytest.approx(np.mean(areas[r.point_id])) and r.std_m2 == pytest.approx(np.std(areas[r.point_id]))


def test_an_ensemble_needs_spacings():
    with pytest.raises(AnalysisError):
        ensemble.spacings(grid(5), 5, (10.0, 0.0))


def painted():
    """A pond and a village on bare ground, 5 m to a cell, and one unseen cell."""
    rng = np.random.default_rng(3)
    rgb = np.empty((70, 60, 3))
    rgb[:] = (0.50, 0.42, 0.25)
    rgb[5:25, 5:25] = (0.10, 0.20, 0.30)
    rgb[5:25, 35:55] = rng.choice([0.2, 0.95], (20, 20, 1)) * np.ones(3)
    rgb[65, 50] = np.nan
    return rgb


def test_classes_of_a_painted_map(spark):
    rgb = painted()
    rows = [(g, r, c, *(None if np.isnan(v) else float(v) for v in rgb[r, c])) for g in (0, 4) for r in range(70) for c in range(60)]
    land = imagery.classify(spark.createDataFrame(rows, "grid_id int, row int, col int, r double, g double, b double"), 60, 5.0).collect()
    assert len(land) == 2 * 70 * 60
    kind = {(r.grid_id, r.row, r.col): r["class"] for r in land}
    assert all(kind[0, r, c] == kind[4, r, c] for r in range(70) for c in range(60)) and kind[0, 65, 50] is None
    for (r0, c0), want in (((9, 9), imagery.WATER), ((9, 39), imagery.BUILT), ((45, 38), imagery.AVAILABLE)):
        assert {kind[0, r, c] for r in range(r0, r0 + 12) for c in range(c0, c0 + 12)} == {want}, want
    areas = {r["class"]: (r.area_m2, r.share) for r in imagery.land_availability(spark.createDataFrame([r for r in land if r.grid_id == 0], "grid_id int, row int, col int, class int"), 5.0).collect()}
    assert 0.8 * 400 * 25 < areas[imagery.WATER][0] < 1.2 * 400 * 25 and abs(sum(s for _, s in areas.values()) - 1) < 1e-3


def test_leaves_are_green_rough_and_dark(spark):
    rows = [(0, 0.5, 0.1, 0.2), (1, 0.5, 0.1, 0.31), (2, 0.5, 0.04, 0.2), (3, 0.29, 0.1, 0.2)]
    got = spark.createDataFrame(rows, "id int, exg double, texture double, brightness double").where(imagery.has("leafy")).collect()
    assert [r.id for r in got] == [0]


@pytest.mark.parametrize(("metres", "cells"), [(15.4, 3), (2.2, 7), (0.5, 31), (1.1, 15), (1.28, 13)])
def test_the_window_of_texture_has_a_middle(metres, cells):
    assert imagery.odd_window(metres) == cells


@pytest.mark.parametrize(("few", "buckets"), [(20_000, 1024), (5, 4), (1, 2)])
def test_quantiles_are_exact(spark, few, buckets):
    """Ties, one value, one far away, numbers of all sizes, nulls and a group without values."""
    rng = np.random.default_rng(6)
    groups = {0: rng.normal(size=801), 1: np.full(300, 2.5), 2: np.array([7.0]), 3: np.concatenate([np.zeros(200), [1e300, -1e300]]), 4: np.exp(rng.normal(0, 30, 400)), None: rng.integers(0, 4, 90).astype(float), 6: np.array([])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(0, None), (6, None), (4, float("nan"))]
    at = [0.0, 0.5, 0.95, 0.999, 1.0]
    got = quantiles(spark.createDataFrame(rows, "g int, v double").repartition(3), ["g"], F.col("v"), at, few, buckets).collect()
    assert {r.g for r in got} == {0, 1, 2, 3, 4, None}
    for r in got:
        assert [r[f"q{i}"] for i in range(len(at))] == pytest.approx(np.quantile(groups[r.g], at).tolist(), rel=1e-12)
    assert quantiles(spark.createDataFrame([], "g int, v double"), ["g"], F.col("v"), at).count() == 0
