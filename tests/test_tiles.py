"""Many tiles are flooded in one call, cut where they end."""

import numpy as np
import pandas as pd

from rillflow.operators import graph


def test_batches_are_cut_where_tiles_end_and_flooded_together():
    rng = np.random.default_rng(3)
    rows = []
    for g in ("0:1", "0:2", "0:3"):
        for t in range(3):
            for r in range(-1, 5):
                for c in range(4):
                    if rng.random() < 0.8:
                        z = float(rng.integers(0, 20))
                        rows.append((g, r + 4 * t, c, z, z if rng.random() < 0.2 else np.inf, t, 0, not 0 <= r < 4))
    df = pd.DataFrame(rows, columns=["grid_id", "row", "col", "z", "level", "t_row", "t_col", "rim"])
    batches = list(graph._whole_tiles(iter([df[:50], df[50:55], df[55:55], df[55:]])))
    assert sum(map(len, batches)) == len(df) and all(len(b.groupby(["grid_id", "t_row"])) == b["_tile"].max() + 1 for b in batches)
    assert len(batches) < df.groupby(["grid_id", "t_row"]).ngroups
    got = pd.concat(graph._relax(b, 0.5, 4) for b in batches)
    want = {}
    for (g, t), tile in df.groupby(["grid_id", "t_row"]):
        cells = {(r.row, r.col): [r.z, r.level, r.rim] for r in tile.itertuples()}
        moved = True
        while moved:
            moved = False
            for (r, c), cell in cells.items():
                near = [cells[r + a, c + b][1] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (r + a, c + b) in cells]
                low = max(cell[0], min(near, default=np.inf) + 0.5)
                if not cell[2] and low < cell[1]:
                    cell[1], moved = low, True
        want |= {(g, r, c): cell[1] for (r, c), cell in cells.items() if not cell[2]}
    assert {(r.grid_id, r.row, r.col): r.new for r in got.itertuples()} == want
