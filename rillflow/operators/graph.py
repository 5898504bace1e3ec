"""Flow graphs and connected cells as iterated joins.

A flow graph is a DataFrame (grid_id, cell, receiver): every cell drains to one receiver,
or to none. Pointer doubling resolves it in about log2 of the longest path rounds; a
round is one aggregate and one or two joins on (grid_id, cell), and is written to the
shared folder, so that plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..session import discard, settled, shuffled

KEY = ["grid_id", "cell"]


def accumulate(flow: DataFrame, weight: str | None = None) -> DataFrame:
    """(grid_id, cell, accumulation): the weights, or the number, of all cells that drain through each, itself included."""
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    state = settled(flow.select(*KEY, F.col("receiver").alias("jump"), own.alias("total")))
    while state.where("jump is not null").limit(1).count():
        added = state.where("jump is not null").groupBy("grid_id", F.col("jump").alias("cell")).agg(F.sum("total").alias("added"))
        further = state.select("grid_id", F.col("cell").alias("jump"), F.col("jump").alias("further"))
        before, state = state, settled(
            state.join(shuffled(added), KEY, "left")
            .join(shuffled(further), ["grid_id", "jump"], "left")
            .select(*KEY, F.col("further").alias("jump"), (F.col("total") + F.coalesce("added", F.lit(0.0))).alias("total"))
        )
        discard(before)
    return state.select(*KEY, F.col("total").alias("accumulation"))


def drain(flow: DataFrame, stops: DataFrame | None = None, n_cols: int | Column | None = None, along: str | None = None) -> DataFrame:
    """(grid_id, cell, root, straight, diagonal): where each cell's water ends, and the steps on the way.

    Cells of ``stops`` (grid_id, cell) drain nowhere further. Steps are counted only if
    ``n_cols`` tells rows from columns; as a column it may differ from grid to grid. The
    column ``along``, if there is one, is added up over the cells on the way and returned too.
    """
    width = n_cols if isinstance(n_cols, Column) else F.lit(n_cols)
    ends = flow.select(*KEY, "receiver", (F.col(along) if along else F.lit(0)).cast("long").alias("along"), width.cast("long").alias("width"))
    if stops is not None:
        ends = ends.join(shuffled(stops.select(*KEY, F.lit(True).alias("stop")).distinct()), KEY, "left").select(*KEY, F.when(F.col("stop").isNull(), F.col("receiver")).alias("receiver"), "along", "width")
    moved = F.col("receiver").isNotNull()
    if n_cols is not None:
        across = (F.floor(F.col("cell") / F.col("width")) != F.floor(F.col("receiver") / F.col("width"))) & (F.col("cell") % F.col("width") != F.col("receiver") % F.col("width"))
        straight, diagonal = F.when(moved & ~across, 1).otherwise(0), F.when(moved & across, 1).otherwise(0)
    else:
        straight = diagonal = F.lit(0)
    # what a cell adds counts up to the next cell; that of a root counts nowhere
    counted = {"straight": straight, "diagonal": diagonal} | ({"along": F.when(moved, F.col("along")).otherwise(0)} if along else {})
    state = last = settled(ends.select(*KEY, F.coalesce("receiver", "cell").alias("root"), *(c.cast("long").alias(n) for n, c in counted.items())))
    while True:
        after = state.select("grid_id", F.col("cell").alias("root"), F.col("root").alias("_root"), *(F.col(n).alias(f"_{n}") for n in counted))
        new = settled(
            state.join(shuffled(after), ["grid_id", "root"]).select(*KEY, F.col("_root").alias("root"), *((F.col(n) + F.col(f"_{n}")).alias(n) for n in counted), (F.col("root") != F.col("_root")).alias("moved"))
        )
        discard(last)
        last, state = new, new.drop("moved")
        if not new.where("moved").limit(1).count():
            return state


def tour(flow: DataFrame, n_cols: int | Column | None = None) -> DataFrame:
    """(grid_id, cell, root, pre, size, straight, diagonal): the order in which a walk against the flow meets the cells of each root.

    All that drains through a cell has the numbers ``pre`` to ``pre + size - 1``. ``size``
    comes from one doubling; a cell's number is its receiver's plus one and the sizes of the
    donors before it, so a second doubling adds those up along the flow.
    """
    sizes = accumulate(flow).select(*KEY, F.col("accumulation").cast("long").alias("size"))
    sized = settled(flow.select(*KEY, "receiver", *([n_cols.alias("_width")] if isinstance(n_cols, Column) else [])).join(shuffled(sizes), KEY))
    donors = W.partitionBy("grid_id", "receiver").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    # roots have no receiver in common: they must not meet in one window
    below = sized.where("receiver IS NOT NULL").withColumn("before", F.coalesce(F.sum("size").over(donors), F.lit(0)) + 1)
    ordered = below.unionByName(sized.where("receiver IS NULL").withColumn("before", F.lit(0).cast("long")))
    width = F.col("_width") if isinstance(n_cols, Column) else n_cols
    return settled(drain(ordered, n_cols=width, along="before").withColumnRenamed("along", "pre").join(shuffled(sizes), KEY))


#: Widths of the blocks by which numbers of a tour meet ranges of them, as a power of two.
_STEP_BITS = 4


def within(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each of ``points`` (grid_id, root, pre, ...) beside each of ``ranges`` (grid_id, root, lo, size, ...) that holds its number.

    A range is looked up in blocks of the largest power of 16 up to its size: at most 17 of
    them, of which the two at its ends hold other numbers too. So the join is on equal
    blocks, and meets at most three times as many pairs as it returns.
    """
    sized = ranges.withColumn("bits", F.expr(f"cast((length(bin(size)) - 1) div {_STEP_BITS} * {_STEP_BITS} as int)"))
    used = sorted(r.bits for r in sized.select("bits").distinct().collect())  # at most 16 numbers
    cut = lambda c: F.expr(f"shiftright({c}, bits)")
    blocks = sized.withColumn("block", F.explode(F.sequence(cut("lo"), cut("lo + size - 1"))))
    dealt = points.withColumn("bits", F.explode(F.lit(used).cast("array<int>"))).withColumn("block", cut("pre"))
    held = dealt.join(shuffled(blocks), ["grid_id", "root", "bits", "block"]).where("pre >= lo AND pre < lo + size")
    return held.drop("bits", "block")


def members_of(toured: DataFrame, outlets: DataFrame) -> DataFrame:
    """(grid_id, cell, outlet, straight, diagonal): all cells that drain through each outlet, and the steps on the way to it.

    Outlets may lie above one another: a cell belongs to each that its water passes.
    """
    wanted = toured.join(shuffled(outlets.select(*KEY).distinct()), KEY, "left_semi")
    ranges = wanted.select("grid_id", "root", F.col("cell").alias("outlet"), F.col("pre").alias("lo"), "size", F.col("straight").alias("_straight"), F.col("diagonal").alias("_diagonal"))
    points = toured.select("grid_id", "root", "cell", "pre", "straight", "diagonal")
    steps = ((F.col(c) - F.col(f"_{c}")).alias(c) for c in ("straight", "diagonal"))
    return within(points, ranges).select("grid_id", "cell", "outlet", *steps)


def upstream(flow: DataFrame, outlets: DataFrame, n_cols: int | Column | None = None) -> DataFrame:
    """``members_of`` the tour of a flow graph."""
    return members_of(tour(flow, n_cols), outlets)


def longest_path(members: DataFrame, resolution_m: float) -> DataFrame:
    """(grid_id, outlet, length_m, remote_cell): the farthest cell along the flow; of equals, the smallest cell."""
    length = (F.col("straight") + F.col("diagonal") * math.sqrt(2.0)) * resolution_m
    best = F.max(F.struct(length.alias("length_m"), (-F.col("cell")).alias("minus")))
    return members.groupBy("grid_id", "outlet").agg(best.alias("best")).select("grid_id", "outlet", F.col("best.length_m").alias("length_m"), (-F.col("best.minus")).alias("remote_cell"))


def flow_paths(toured: DataFrame, starts: DataFrame) -> DataFrame:
    """(grid_id, outlet, step, cell): the way of the water from each start (grid_id, outlet, cell) to its outlet, both included.

    A start's water passes the cells whose range of a tour holds the start's number; on the
    way to an outlet are those of them that lie no further down than it. Outlets may lie
    above one another, and starts may share their ways. Each outlet has one start.
    """
    depth = F.col("straight") + F.col("diagonal")
    own = toured.select(*KEY, "root", "pre", depth.alias("depth"))
    ends = own.select("grid_id", F.col("cell").alias("outlet"), F.col("depth").alias("end"))
    points = own.join(shuffled(starts.select("grid_id", "outlet", "cell").distinct()), KEY).join(shuffled(ends), ["grid_id", "outlet"]).select("grid_id", "root", "pre", "outlet", F.col("depth").alias("start"), "end")
    passed = toured.select("grid_id", "root", "cell", F.col("pre").alias("lo"), "size", depth.alias("depth"))
    return within(points, passed).where("depth >= end").select("grid_id", "outlet", (F.col("start") - F.col("depth")).alias("step"), "cell")


def height_above(flow: DataFrame, trunk: DataFrame, value: str = "z") -> DataFrame:
    """(grid_id, cell, above): height above the first trunk cell downstream.

    Infinite where a grid has no trunk at all; minus infinite where water leaves the map before it meets one.
    """
    reached = drain(flow, trunk)
    marks = trunk.select("grid_id", F.col("cell").alias("root"), F.lit(True).alias("is_trunk")).distinct()
    beds = flow.select("grid_id", F.col("cell").alias("root"), F.col(value).alias("bed"))
    mapped = trunk.select("grid_id", F.lit(True).alias("has_trunk")).distinct()
    joined = reached.join(shuffled(marks), ["grid_id", "root"], "left").join(shuffled(beds), ["grid_id", "root"]).join(shuffled(flow.select(*KEY, value)), KEY).join(mapped, "grid_id", "left")
    above = F.when(F.col("has_trunk").isNull(), F.lit(float("inf"))).when(F.col("is_trunk"), F.col(value) - F.col("bed")).otherwise(F.lit(float("-inf")))
    return joined.select(*KEY, above.alias("above"))


def connected(edges: DataFrame) -> DataFrame:
    """(grid_id, node, root) of every node of an edge (grid_id, a, b): root is the smallest node reachable."""
    edges = settled(edges.where("a <> b").select("grid_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("grid_id", "a", "b"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select("grid_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("grid_id", "a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(shuffled(low), ["grid_id", "a"]).where("b > a").select("grid_id", F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("grid_id", "a").agg(F.min("b").alias("low"))
        small = large.join(shuffled(low), ["grid_id", "a"]).where("b <> low").select("grid_id", F.col("b").alias("a"), F.col("low").alias("b"))
        last, edges = edges, settled(small.unionByName(low.withColumnRenamed("low", "b")).distinct())
        discard(last)
        now = state(edges)
        if now == before:
            break
        before = now
    hung = edges.select("grid_id", F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(hung.select("grid_id", F.col("root").alias("node"), "root").distinct())


def chains(links: DataFrame, at_once: int = 2) -> DataFrame:
    """(grid_id, cell, chain, step, closed): the order of cells along chains (grid_id, cell, receiver) in which no two share a receiver.

    ``chain`` is the chain's smallest cell, ``step`` counts from its first cell, or from the
    smallest where it is closed. Every cell looks twice as far ahead in each round, and
    keeps the smallest cell it has seen and how far away that is: an open chain then knows
    its distance from the end, a closed one that from its smallest cell. ``at_once`` rounds
    are made before a table is written.
    """
    end = F.col("receiver").isNull()
    state = last = settled(links.select(*KEY, F.coalesce("receiver", "cell").alias("far"), F.when(end, 0).otherwise(1).cast("long").alias("steps"), end.alias("done"), F.col("cell").alias("low"), F.lit(0).cast("long").alias("to_low"), F.lit(False).alias("moved")))
    while True:
        for _ in range(at_once):
            ahead = state.select("grid_id", F.col("cell").alias("far"), *(F.col(c).alias(f"_{c}") for c in ("far", "steps", "done", "low", "to_low")))
            lower = F.col("_low") < F.col("low")
            state = state.join(shuffled(ahead), ["grid_id", "far"]).select(
                *KEY, F.col("_far").alias("far"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"),
                F.when(lower, F.col("steps") + F.col("_to_low")).otherwise(F.col("to_low")).alias("to_low"), (lower | (F.col("_done") & ~F.col("done"))).alias("moved"),
            )
        before, state = last, settled(state)
        last = state
        discard(before)
        # as long as some cell is not through, the nearest to an end or to the smallest cell gets there in each round
        if not state.where("moved").limit(1).count():
            break
    whose = state.withColumn("whose", F.when(F.col("done"), F.col("far")).otherwise(F.col("low")))
    each = whose.groupBy("grid_id", "whose").agg(F.min("low").alias("chain"), F.max("steps").alias("most"), F.count("*").alias("n"))
    step = F.when(F.col("done"), F.col("most") - F.col("steps")).otherwise(F.pmod(F.col("n") - F.col("to_low"), F.col("n")))
    return whose.join(shuffled(each), ["grid_id", "whose"]).select(*KEY, "chain", step.alias("step"), (~F.col("done")).alias("closed"))


def patches(cells: DataFrame, n_cols: int, diagonal: bool = False) -> DataFrame:
    """(grid_id, row, col, cell, patch): connected patches of the given cells, named by their smallest cell."""
    cells = cells.select("grid_id", "row", "col", (F.col("row").cast("long") * n_cols + F.col("col")).alias("cell"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    wanted = cells.select("grid_id", F.col("cell").alias("a"), F.explode(F.array(*(F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in steps))).alias("n"))
    edges = wanted.select("grid_id", "a", F.col("n.row").alias("row"), F.col("n.col").alias("col")).join(shuffled(cells.withColumnRenamed("cell", "b")), ["grid_id", "row", "col"]).select("grid_id", "a", "b")
    roots = connected(edges)
    return cells.join(shuffled(roots.select("grid_id", F.col("node").alias("cell"), "root")), KEY, "left").select("grid_id", "row", "col", "cell", F.coalesce("root", "cell").alias("patch"))


#: Steps (row, col) to the cells around one.
_AROUND = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)


def _relax(tiles: pd.DataFrame, epsilon: float, tile: int) -> pd.DataFrame:
    """Least flood levels inside whole tiles, given what their own cells and the rims around them have reached so far.

    ``tiles`` are numbered by ``_tile``. Tiles have no neighbours in common, so one heap
    serves all; it begins with the cells that can lower one beside them.
    """
    n, wide = len(tiles), tile + 4
    number, rows, cols = (tiles[c].to_numpy().astype(np.int64) for c in ("_tile", "row", "col"))
    place = (number * wide + rows - tiles["t_row"].to_numpy() * tile + 2) * wide + cols - tiles["t_col"].to_numpy() * tile + 2
    order = np.argsort(place, kind="stable")
    known = place[order]
    # one more cell, which nothing lowers, stands where there is none
    ground, level, fixed = np.append(tiles["z"].to_numpy(), np.inf), np.append(tiles["level"].to_numpy(), np.inf), np.append(tiles["rim"].to_numpy().astype(bool), True)
    near, starts = np.full((n, 8), n), np.zeros(n, bool)
    for k, (a, b) in enumerate(_AROUND):
        at = np.minimum(np.searchsorted(known, place + a * wide + b), n - 1)
        there = known[at] == place + a * wide + b
        near[there, k] = order[at[there]]
        other = near[:, k]
        starts |= ~fixed[other] & (np.maximum(ground[other], level[:n] + epsilon) < level[other])
    f = level.tolist()
    heap = [(f[p], p) for p in np.flatnonzero(starts).tolist()]
    if heap:
        heapq.heapify(heap)
        z, held, beside = ground.tolist(), fixed.tolist(), near.tolist()
        while heap:
            here, p = heapq.heappop(heap)
            if here > f[p]:
                continue
            floor = here + epsilon
            for q in beside[p]:
                if held[q]:
                    continue
                new = z[q] if z[q] > floor else floor
                if new < f[q]:
                    f[q] = new
                    heapq.heappush(heap, (new, q))
    tiles = tiles.assign(new=np.array(f[:n]))
    own = tiles[~tiles["rim"]]
    return own.assign(changed=own["new"] < own["level"])[["grid_id", "row", "col", "z", "new", "changed"]]


def _whole_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by tile, cut where tiles end, with the tiles of each numbered from 0."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        both = pd.concat([*rest, batch], ignore_index=True) if rest else batch.reset_index(drop=True)
        keys = [pd.factorize(both["grid_id"])[0], both["t_row"].to_numpy(), both["t_col"].to_numpy()]
        new = np.zeros(len(both), np.int64)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        number = np.cumsum(new)
        last = int(np.searchsorted(number, number[-1]))
        rest = [both.iloc[last:]]
        if last:
            yield both.iloc[:last].assign(_tile=number[:last]).reset_index(drop=True)
    if rest:
        yield rest[0].assign(_tile=0).reset_index(drop=True)


def flood(cells: DataFrame, epsilon: float, tile: int = 128) -> DataFrame:
    """(grid_id, row, col, z, level): the least fixpoint of level = max(z, epsilon + lowest level around).

    ``cells`` has z and ``seed``; a seed's level is its own z. Each round floods every tile
    to its own fixpoint with a heap for a batch of tiles and then hands the rims to the tiles around, until no
    tile changes. Rounds grow with the number of tiles that a flood path crosses.
    """
    start = F.when(F.col("seed"), F.col("z")).otherwise(F.lit(float("inf")))
    state = last = settled(cells.select("grid_id", "row", "col", F.col("z").cast("double").alias("z"), start.alias("level")))
    part, place = "grid_id int, row int, col int, z double, new double, changed boolean", ["t_row", "t_col"]
    grid_type = cells.schema["grid_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tiles in _whole_tiles(batches):
            yield _relax(tiles, epsilon, tile)

    while True:
        t_row, t_col = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
        tiles = F.array_distinct(
            F.flatten(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda a: F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda b: F.struct(F.floor((F.col("row") + a) / tile).alias("t_row"), F.floor((F.col("col") + b) / tile).alias("t_col")))))
        )
        dealt = state.withColumn("t", F.explode(tiles)).select("grid_id", "row", "col", "z", "level", F.col("t.t_row").alias("t_row"), F.col("t.t_col").alias("t_col"), ((F.col("t.t_row") != t_row) | (F.col("t.t_col") != t_col)).alias("rim"))
        # many tiles to a batch: masks of a few cells are far too many for a call each
        made = settled(dealt.repartition("grid_id", *place).sortWithinPartitions("grid_id", *place).mapInPandas(run, part.replace("grid_id int", f"grid_id {grid_type}")))
        discard(last)
        last, state = made, made.select("grid_id", "row", "col", "z", F.col("new").alias("level"))
        if not made.where("changed").limit(1).count():
            return state


def fill_depressions(lattice: DataFrame, epsilon: float | None = None, tile: int = 128) -> DataFrame:
    """(grid_id, row, col, z, filled): pits raised until every cell can drain off the map or into a gap in it."""
    from .focal import with_neighbours

    wide = with_neighbours(lattice, "z").where(F.col("z").isNotNull())
    cells = wide.select("grid_id", "row", "col", "z", F.exists("near", lambda v: v.isNull()).alias("seed"))
    return flood(cells, settings.flow.fill_step_m if epsilon is None else epsilon, tile).withColumnRenamed("level", "filled")


def reaches(flow: DataFrame, stream: DataFrame) -> DataFrame:
    """(grid_id, head, step, cell): stream cells in chains that run from a source or confluence down to the next confluence, both included."""
    on = stream.select(*KEY).distinct()
    links = flow.select(*KEY, "receiver").join(shuffled(on), KEY, "left_semi").join(shuffled(on.select("grid_id", F.col("cell").alias("receiver"), F.lit(True).alias("on"))), ["grid_id", "receiver"], "left")
    links = settled(links.select(*KEY, F.when(F.col("on"), F.col("receiver")).alias("next")))
    donors = links.where("next is not null").groupBy("grid_id", F.col("next").alias("cell")).agg(F.count("*").alias("donors"))
    sized = links.join(shuffled(donors), KEY, "left").select(*KEY, "next", (F.coalesce("donors", F.lit(0)) != 1).alias("is_head"))
    # going upstream, a cell that is no head has exactly one donor
    above = links.where("next is not null").select("grid_id", F.col("next").alias("cell"), F.col("cell").alias("up"))
    up = sized.where("not is_head").join(shuffled(above), KEY).select(*KEY, F.col("up").alias("receiver"))
    chain = drain(up.unionByName(sized.where("is_head").select(*KEY, F.lit(None).cast("long").alias("receiver"))), n_cols=1)
    own = chain.select("grid_id", F.col("root").alias("head"), (F.col("straight") + F.col("diagonal")).alias("step"), "cell")
    # the confluence below a chain is its last cell and the head of another
    last = own.join(shuffled(sized), KEY).where("next is not null").join(shuffled(sized.select("grid_id", F.col("cell").alias("next"), F.col("is_head").alias("ends"))), ["grid_id", "next"]).where("ends")
    tails = last.select("grid_id", "head", (F.col("step") + 1).alias("step"), F.col("next").alias("cell"))
    whole = own.unionByName(tails)
    sizes = whole.groupBy("grid_id", "head").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return whole.join(shuffled(sizes), ["grid_id", "head"], "left_semi")
