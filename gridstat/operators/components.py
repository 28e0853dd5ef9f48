"""Eight-connected components of masks of any size: labels in tiles, joined at the tiles' borders.

Inside a tile, horizontal runs of cells are nodes, runs that touch in neighbouring rows are
edges, and labels are brought down to the smallest one by hooking and halving paths, all on
whole arrays. A tile hands on the size of each of its components and the labels of its border
cells. Border cells of different tiles that touch are edges of a graph over components; its
rounds (smallest label of the neighbours, then the label's own label) keep their tables as
Parquet. What a task sees is one tile; the graph has a node a component that touches a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.sources.steps import Steps


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for edges a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))  # hook the larger root under the smaller
        while (root != root[root]).any():
            root = root[root]
    return root


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last, component) of the horizontal runs of a mask; components count from 0."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    after = np.nonzero(step == -1)[1]
    wide = w + 3
    begins, ends = row * wide + first, row * wide + after
    # Runs of the next row that begin at or before this one's end, and end at or after its beginning.
    low = np.searchsorted(ends, (row + 1) * wide + first, side="left")
    high = np.searchsorted(begins, (row + 1) * wide + after, side="right")
    times = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), times)
    b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    label = np.unique(roots(len(row), a, b), return_inverse=True)[1]
    return row, first, after, label


def sizes_of(mask: np.ndarray) -> list[float]:
    """Sizes of a mask's components, by their first cell."""
    _, first, after, label = runs_of(mask)
    return np.bincount(label, weights=after - first).tolist() if len(label) else []


def _labelled(h: int, w: int, row: np.ndarray, first: np.ndarray, after: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Component of each cell, -1 outside."""
    step = np.zeros((h, w + 1), np.int64)
    np.add.at(step, (row, first), label + 1)
    np.add.at(step, (row, after), -(label + 1))
    return np.cumsum(step, axis=1)[:, :w] - 1


SIZE, BORDER = 0, 1
#: Cells of tiles that are looked at together.
STACK = 1 << 22

_OUT = "ty long, tx long, kind int, component long, y long, x long, n long"


def tile_components(tiles: DataFrame, key: str) -> DataFrame:
    """Of tiles (key, ty, tx, y, x, h, w, mask): a row a component (n cells), and a row a border cell of one (y, x of the whole grid)."""
    kind = tiles.schema[key].dataType.simpleString()
    given = tiles.select(key, *(F.col(c).cast("long").alias(c) for c in ("ty", "tx", "y", "x", "h", "w")), F.col("mask").cast("array<boolean>").alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = (batch.column(c).to_numpy() for c in (5, 6))
            for shape in np.unique(np.stack([h, w], axis=1), axis=0):
                at = np.flatnonzero((h == shape[0]) & (w == shape[1]))
                many = max(1, STACK // max(1, int(shape.prod())))
                for first in range(0, len(at), many):
                    yield from stacked(batch.take(pa.array(at[first : first + many])), int(shape[0]), int(shape[1]))

    def stacked(batch: pa.RecordBatch, h: int, w: int) -> Iterator[pa.RecordBatch]:
        """Tiles of one shape under one another, an empty row between two, so that no component reaches the next tile."""
        tiles_ = batch.num_rows
        mask = np.zeros((tiles_, h + 1, w), bool)
        mask[:, :h] = batch.column(7).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(tiles_, h, w)
        row, first, after, label = runs_of(mask.reshape(-1, w))
        if not len(row):
            return
        n = np.bincount(label, weights=after - first).astype(np.int64)
        of = np.zeros(len(n), np.int64)
        of[label] = row // (h + 1)  # components are numbered tile after tile
        number = np.arange(len(n)) - np.searchsorted(of, of)
        cells = _labelled(tiles_ * (h + 1), w, row, first, after, label).reshape(tiles_, h + 1, w)[:, :h]
        edge = np.zeros((h, w), bool)
        edge[[0, -1]], edge[:, [0, -1]] = True, True
        tile, by, bx = np.nonzero(edge & (cells >= 0))
        k, b = len(n), len(tile)
        source = np.r_[of, tile]
        ty, tx, y, x = (batch.column(c).to_numpy() for c in (1, 2, 3, 4))
        columns = {
            "ty": ty[source], "tx": tx[source], "kind": np.repeat([SIZE, BORDER], [k, b]).astype(np.int32), "component": np.r_[number, number[cells[tile, by, bx]]],
            "y": np.r_[np.zeros(k, np.int64), by + y[tile]], "x": np.r_[np.zeros(k, np.int64), bx + x[tile]], "n": np.r_[n, np.zeros(b, np.int64)],
        }
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), *map(pa.array, columns.values())], names=[key, *columns])

    return given.mapInArrow(run, f"{key} {kind}, {_OUT}")


def smallest_labels(edges: DataFrame, keys: list[str], a: str, b: str, steps: Steps, step: int = 0) -> DataFrame:
    """(keys, node, label) of the nodes of edges: the smallest node of each one's component."""
    both = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(*keys, F.col(b).alias("node"), F.col(a).alias("other"))).distinct()
    both = steps.write(step, both)
    now = steps.write(step + 1, both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("label"), F.lit(True).alias("moved")))
    at = step + 1
    while not now.where("moved").isEmpty():
        near = both.join(now.select(*keys, F.col("node").alias("other"), "label"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("label").alias("near"))
        lower = now.join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        own = lower.select(*keys, F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = lower.join(own, [*keys, "label"]).select(*keys, "node", F.col("beyond").alias("label"), (F.col("beyond") != F.col("was")).alias("moved"))
        at += 1
        now = steps.write(at, jumped)
        steps.files.delete(f"step-{at - 1:06d}")
    return now.select(*keys, "node", "label")


def component_sizes(tiles: DataFrame, key: str) -> DataFrame:
    """(key, component, n): the components of grids given as tiles; a component is named by its smallest (ty, tx, number)."""
    steps = Steps(tiles.sparkSession)
    said = steps.write(0, tile_components(tiles, key))
    node = F.struct("ty", "tx", "component")
    parts = said.where(f"kind = {SIZE}").select(key, node.alias("node"), "n")
    cells = said.where(f"kind = {BORDER}").select(key, node.alias("node"), "y", "x")
    # Each pair of touching cells once: those after a cell in reading order.
    ahead = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("to")
    out = cells.select(key, F.col("node").alias("a"), ahead).select(key, "a", "to.y", "to.x")
    different = (F.col("a.ty") != F.col("node.ty")) | (F.col("a.tx") != F.col("node.tx"))
    edges = out.join(cells, [key, "y", "x"]).where(different).select(key, "a", F.col("node").alias("b"))
    labels = smallest_labels(edges, [key], "a", "b", steps, 1)
    whole = parts.join(labels, [key, "node"], "left").select(key, F.coalesce("label", "node").alias("component"), "n")
    return whole.groupBy(key, "component").agg(F.sum("n").alias("n"))


def tiled(fields: DataFrame, key: str, mask: F.Column, side: int) -> DataFrame:
    """Tiles of packed grids (key, h, w, data): `mask` is an array of booleans of the grid's cells."""
    grid = fields.select(key, "h", "w", mask.alias("whole"))
    count = lambda n: F.floor((F.col(n) - 1) / side)
    at = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count("h"))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), count("w"))).alias("tx"))
    at = at.select(key, "ty", "tx", (F.col("ty") * side).alias("y"), (F.col("tx") * side).alias("x"), "h", "w", "whole")
    h, w = F.least(F.lit(side), F.col("h") - F.col("y")), F.least(F.lit(side), F.col("w") - F.col("x"))
    rows = F.transform(F.sequence(F.lit(0), (h - 1).cast("int")), lambda i: F.slice("whole", ((F.col("y") + i) * F.col("w") + F.col("x") + 1).cast("int"), w.cast("int")))
    cut = at.select(key, "ty", "tx", "y", "x", h.alias("rows"), w.alias("columns"), F.flatten(rows).alias("mask"))
    return cut.withColumnsRenamed({"rows": "h", "columns": "w"})
