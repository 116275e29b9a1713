"""An adaptive quadtree as a table of leaves, probed by an equi-join.

Cells of depth d are squares of a 2**d grid over the padded root.  A cell with
more than ``leaf`` parts is split until ``depth``; parts go to every child that
their closed bounds meet.  Leaves without parts are kept, so leaves tile the
root and each point finds exactly one.  Points find it through a directory: a
grid at the leaves' depth (``GRID`` at most), where each cell holds the parts of
the leaves that cover it or lie in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.model import Domain

#: Parts of a leaf and depth; results don't depend on them.
LEAF, DEPTH = 6, 12
#: Share of its size by which the root is padded on each side.
PAD = 0.001


def root_of(d: Domain) -> Domain:
    """The padded root."""
    px, py = (d.max_x - d.min_x) * PAD, (d.max_y - d.min_y) * PAD
    return Domain(d.min_x - px, d.min_y - py, d.max_x + px, d.max_y + py)


def _range(root: Domain, depth: int) -> dict[str, Column]:
    n = 1 << depth
    at = lambda c, a: C.slot(F.col(f"{c}_{a}"), getattr(root, f"min_{a}"), getattr(root, f"max_{a}"), n)
    return {"x_from": at("min", "x"), "x_to": at("max", "x"), "y_from": at("min", "y"), "y_to": at("max", "y")}


#: Parts up to which the tree is built on the driver from their bounds alone (48 bytes each).
ON_DRIVER = 250_000


def leaves(parts: DataFrame, domain: Domain, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Rows depth, cx, cy, n (parts) and ids (array of polygon_id and part_no)."""
    if parts.count() > ON_DRIVER:
        return _distributed(parts, domain, leaf, depth)
    bounds = parts.select("polygon_id", "part_no", "min_x", "max_x", "min_y", "max_y").toArrow()
    sides = {c: np.asarray(bounds[c]) for c in ("min_x", "max_x", "min_y", "max_y")}
    ids = list(zip(bounds["polygon_id"].to_pylist(), bounds["part_no"].to_pylist(), strict=True))
    root = root_of(domain)

    def slots(side: str, at: int) -> np.ndarray:
        axis = side[-1]
        low, high = getattr(root, f"min_{axis}"), getattr(root, f"max_{axis}")
        return np.clip(np.floor((sides[side] - low) / (high - low) * float(1 << at)), 0, (1 << at) - 1).astype(np.int64)

    rows: list[tuple] = []
    level = {(0, 0): np.arange(len(ids))}
    for d in range(depth + 1):
        crowded = {c: held for c, held in level.items() if len(held) > leaf and d < depth}
        rows += [(d, *c, len(held), [ids[i] for i in held.tolist()]) for c, held in level.items() if c not in crowded]
        if not crowded:
            break
        x0, x1, y0, y1 = (slots(s, d + 1) for s in ("min_x", "max_x", "min_y", "max_y"))
        level = {}
        for (cx, cy), held in crowded.items():
            for x, y in ((2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)):
                level[x, y] = held[(x0[held] <= x) & (x <= x1[held]) & (y0[held] <= y) & (y <= y1[held])]
    return parts.sparkSession.createDataFrame(rows, "depth int, cx int, cy int, n int, ids array<struct<polygon_id:bigint,part_no:int>>")


def _distributed(parts: DataFrame, domain: Domain, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """The same for any number of parts: one level of cells at a time.  Parts are gathered in leaves only."""
    root = root_of(domain)
    held = parts.select("polygon_id", "part_no", "min_x", "min_y", "max_x", "max_y").withColumns({"cx": F.lit(0), "cy": F.lit(0)})
    open_cells = parts.sparkSession.range(1).select(F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    none = F.array().cast("array<struct<polygon_id:bigint,part_no:int>>")
    out = None
    for d in range(depth + 1):
        counts = held.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        level = open_cells.join(counts, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("n", F.lit(0)).alias("n")).persist()
        small = level if d == depth else level.where(F.col("n") <= leaf)
        ids = held.join(small.select("cx", "cy"), ["cx", "cy"]).groupBy("cx", "cy").agg(F.collect_list(F.struct("polygon_id", "part_no")).alias("ids"))
        done = small.join(ids, ["cx", "cy"], "left").select(F.lit(d).alias("depth"), "cx", "cy", F.col("n").cast("int").alias("n"), F.coalesce("ids", none).alias("ids"))
        out = done if out is None else out.unionByName(done)
        crowded = level.where(F.col("n") > leaf).select("cx", "cy")
        if d == depth or not crowded.limit(1).count():
            break
        child = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
        split = lambda df: df.select("*", child).withColumns({"cx": F.col("cx") * 2 + F.col("c.i"), "cy": F.col("cy") * 2 + F.col("c.j")}).drop("c")
        open_cells = split(crowded)
        below = split(held.join(crowded, ["cx", "cy"])).withColumns(_range(root, d + 1))
        held = below.where(F.col("cx").between(F.col("x_from"), F.col("x_to")) & F.col("cy").between(F.col("y_from"), F.col("y_to"))).drop("x_from", "x_to", "y_from", "y_to").persist()
    return out


#: Depth of the directory's grid at most.
GRID = 8


def directory(parts: DataFrame, domain: Domain, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, dict[str, Column]]:
    """Parts by cell of the directory (_cx, _cy), each once, and a point's cell."""
    root = root_of(domain)
    tree = leaves(parts, domain, leaf, depth).where("n > 0")
    deepest = min(GRID, tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])
    up = F.greatest(F.lit(deepest) - F.col("depth"), F.lit(0))  # levels from a leaf down to the grid
    down = F.greatest(F.col("depth") - F.lit(deepest), F.lit(0))  # or from the grid down to a leaf
    first = {a: F.expr(f"shiftright(shiftleft({a}, up), down)") for a in ("cx", "cy")}
    sized = tree.withColumns({"up": up, "down": down})
    cells = sized.select("ids", *[F.sequence(c, c + F.expr("shiftleft(1, up) - 1")).alias(f"{a}s") for a, c in first.items()])
    cells = cells.select("ids", F.explode("cxs").alias("_cx"), "cys").select("ids", "_cx", F.explode("cys").alias("_cy"))
    entries = cells.select("_cx", "_cy", F.explode("ids").alias("_id")).select("_cx", "_cy", "_id.polygon_id", "_id.part_no").distinct()
    n = 1 << deepest
    keys = {"_cx": C.slot(F.col("x"), root.min_x, root.max_x, n), "_cy": C.slot(F.col("y"), root.min_y, root.max_y, n)}
    return entries.join(parts, ["polygon_id", "part_no"]).select("_cx", "_cy", *parts.columns), keys
