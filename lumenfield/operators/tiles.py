"""Work on images tile by tile: pixels dealt to tiles with the margins that their neighbours lend them.

A tile is ``side`` pixels on an axis, counted from place 0, so that all images share one grid of tiles. Tasks get one tile at a
time as an Arrow table, whatever the size of an image; copies are only made of pixels within the margin of a tile's border.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 128


def dealt(pixels: DataFrame, margin_x: int = 0, margin_y: int = 0, side: int = SIDE) -> DataFrame:
    """``pixels`` with ty and tx of each tile that has them or, within the margins, borrows them."""
    near = lambda c, m: F.explode(F.sequence(F.floor((F.col(c) - m) / side), F.floor((F.col(c) + m) / side)))
    if not margin_x and not margin_y:
        return pixels.withColumns({"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)})
    return pixels.withColumn("ty", near("y", margin_y)).withColumn("tx", near("x", margin_x))


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places reflected at the borders of 0 to n - 1 without repeating the edge."""
    if n == 1:
        return np.zeros_like(i)
    m = i % (2 * n - 2)
    return np.where(m > n - 1, 2 * n - 2 - m, m)


def blurred(num: np.ndarray, weights: np.ndarray, rows: np.ndarray, cols: np.ndarray, weights_y: np.ndarray) -> np.ndarray:
    """Separable convolution of ``num`` padded by the places ``rows`` and ``cols``: along x, then along y."""
    a = num[np.ix_(rows, cols)]
    one = np.zeros((a.shape[0], a.shape[1] - len(weights) + 1))
    for k, w in enumerate(weights):
        one += w * a[:, k : k + one.shape[1]]
    two = np.zeros((one.shape[0] - len(weights_y) + 1, one.shape[1]))
    for k, w in enumerate(weights_y):
        two += w * one[k : k + two.shape[0]]
    return two


def labelled(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For pixels in raster order: the first pixel (as an index) of each one's 8-connected region."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    width = int(x.max() - x.min()) + 3
    at = (y - y.min()) * width + (x - x.min() + 1)  # a column free on each side, so that no neighbour wraps
    ends = []
    for step in (1, width - 1, width, width + 1):
        place = np.searchsorted(at, at + step)
        hit = (place < n) & (at[np.minimum(place, n - 1)] == at + step)
        ends.append((np.flatnonzero(hit), place[hit]))
    u, v = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(n)
    while True:
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def neighbours(side: int = SIDE) -> Column:
    """Places (y, x) after a pixel in raster order that touch it but lie in another tile."""
    tile = lambda c: F.floor(c / side)
    places = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    return F.filter(places, lambda p: (tile(p["y"]) != tile(F.col("y"))) | (tile(p["x"]) != tile(F.col("x"))))
