"""Path-dependent Shapley values of tree ensembles from a table of root-to-leaf paths.

A path is a box of the features that it uses: ``x`` follows feature ``j`` when ``lo_j < x_j <= hi_j``,
which is ``o_j`` in {0, 1}, and ``z_j`` is the share of rows that do, by the counts of the splits.  The
leaf's value times

    (o_j - z_j)  *  integral over t in (0, 1) of the product over k <> j of  z_k (1 - t) + o_k t

is its part of the value of feature ``j``: the integral weighs every coalition of the other features
as Shapley's definition does, without listing one.  The product is a polynomial of a degree below the
path's length, so a few Gauss points give it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import TIMESTAMP

#: Numbers of (row, path, feature) that are held at once.
HELD = 1 << 18


def path_table(trees: list[list[tuple]]) -> dict[str, np.ndarray]:
    """``value`` (path) and ``feature, lo, hi, z`` (path, place) of all leaves; unused places hold z = 1 and an open box.

    A tree is a list of nodes ``(feature or -1, cut, left, right, leaf value, rows, ...)``, the root first.
    """
    found: list[tuple[float, dict]] = []
    for tree in trees:
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            at, box = stack.pop()
            feature, cut, left, right, leaf, rows, *_ = tree[at]
            if feature < 0:
                found.append((leaf, box))
                continue
            lo, hi, z = box.get(feature, (-np.inf, np.inf, 1.0))
            stack.append((left, box | {feature: (lo, min(hi, cut), z * tree[left][5] / rows)}))
            stack.append((right, box | {feature: (max(lo, cut), hi, z * tree[right][5] / rows)}))
    wide = max([1, *(len(b) for _, b in found)])
    out = {"value": np.array([v for v, _ in found], float), "feature": np.zeros((len(found), wide), np.int64), "lo": np.full((len(found), wide), -np.inf), "hi": np.full((len(found), wide), np.inf), "z": np.ones((len(found), wide))}
    for i, (_, box) in enumerate(found):
        for k, (feature, (lo, hi, z)) in enumerate(box.items()):
            out["feature"][i, k], out["lo"][i, k], out["hi"][i, k], out["z"][i, k] = feature, lo, hi, z
    return out


def values(paths: dict[str, np.ndarray], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean of the trees and a value for each row and feature."""
    z, v, feature = paths["z"], paths["value"], paths["feature"]
    out = np.zeros(x.shape)
    if not len(v):
        return 0.0, out
    points, weights = np.polynomial.legendre.leggauss((z.shape[1] + 1) // 2)
    by_feature = np.argsort(feature.ravel(), kind="stable")
    used, begins = np.unique(feature.ravel()[by_feature], return_index=True)
    size = max(1, HELD // z.size)
    for i in range(0, len(x), size):
        own = x[i : i + size][:, feature]
        o = ((own > paths["lo"]) & (own <= paths["hi"])).astype(float)
        total = np.zeros_like(o)
        for t, w in zip((points + 1) / 2, weights / 2):
            factor = z * (1 - t) + o * t  # z > 0, so never 0
            total += (w * factor.prod(axis=2))[:, :, None] / factor
        total *= (o - z) * v[:, None]
        out[i : i + size, used] = np.add.reduceat(total.reshape(len(own), -1)[:, by_feature], begins, axis=1)
    return float((z.prod(axis=1) * v).sum()), out


def shap_rows(matrix: DataFrame, trees: list[list[tuple]], columns: list[str]) -> DataFrame:
    """``timestamp``, ``feature__<name>`` and ``shap__<name>`` of every row; the path table of one model travels with the tasks."""
    shared = matrix.sparkSession.sparkContext.broadcast(path_table(trees))
    names = [TIMESTAMP, *(f"feature__{c}" for c in columns), *(f"shap__{c}" for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(1, len(columns) + 1)]).reshape(b.num_rows, len(columns))
            _, phi = values(shared.value, x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T), *(pa.array(c) for c in phi.T)], names)

    kind = matrix.schema[TIMESTAMP].dataType.simpleString()
    return matrix.select(TIMESTAMP, *columns).mapInArrow(run, f"{TIMESTAMP} {kind}, " + ", ".join(f"`{n}` double" for n in names[1:]))
