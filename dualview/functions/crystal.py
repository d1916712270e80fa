"""Crystal system of a lattice: the symmetry of its reduced cell's metric."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the group of a lattice's symmetries, inversion included, by system.
SYSTEMS = {2: "triclinic", 4: "monoclinic", 8: "orthorhombic", 12: "trigonal", 16: "tetragonal", 24: "hexagonal", 48: "cubic"}
#: What a cell is called that is missing, flat, not finite, or of no system within the tolerance.
UNKNOWN = "unknown"


#: Steps -1, 0, 1 along each reduced vector: the rows of all symmetries of a reduced cell are among them.
MOVES = np.array([s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)], dtype=float)
#: Whether three moves make a matrix of determinant 1 or -1.
UNIMODULAR = np.abs(np.abs(np.einsum("ai,bci->abc", MOVES, np.cross(MOVES[:, None], MOVES[None, :]))) - 1) < 1e-6
STEPS = np.array([s for s in itertools.product((-1, 0, 1), repeat=2) if any(s)], dtype=float)
#: Cells that are looked at in one step.
BLOCK = 4096


def reduced(cells: np.ndarray) -> np.ndarray:
    """Shortest vectors that span the same lattices, (n, 3, 3), in order of length: each is shortened by the two before it until none gets shorter."""
    cells = np.array(cells, dtype=float)
    left = np.arange(len(cells))
    for _ in range(200):
        own = cells[left]
        own = np.take_along_axis(own, np.argsort((own**2).sum(axis=2), axis=1, kind="stable")[:, :, None], axis=1)
        shorter = np.zeros(len(own), dtype=bool)
        for i in (2, 1):
            tried = own[:, [i]] + STEPS @ own[:, [j for j in range(3) if j != i]]
            lengths = (tried**2).sum(axis=2)
            k = lengths.argmin(axis=1)
            at = np.flatnonzero(~shorter & (lengths[np.arange(len(own)), k] < (own[:, i] ** 2).sum(axis=1) * (1 - 1e-10)))
            own[at, i] = tried[at, k[at]]
            shorter[at] = True
        cells[left] = own
        left = left[shorter]
        if not len(left):
            break
    return cells


def _kept(cells: np.ndarray, tolerance: float) -> np.ndarray:
    """How many symmetries each lattice has. Two rows that keep their lengths and angle are found first, so few triples are left to test."""
    own = reduced(cells)
    metric = own @ own.transpose(0, 2, 1)
    products = MOVES @ metric @ MOVES.T
    most = tolerance * metric.max(axis=(1, 2))
    lengths = np.diagonal(products, axis1=1, axis2=2)
    long = [np.abs(lengths - metric[:, [i], i]) <= most[:, None] for i in range(3)]
    near = lambda i, j: np.abs(products - metric[:, i, j][:, None, None]) <= most[:, None, None]
    n, a, b = np.nonzero(near(0, 1) & long[0][:, :, None] & long[1][:, None, :])
    third = near(0, 2)[n, a] & near(1, 2)[n, b] & long[2][n] & UNIMODULAR[a, b]
    return np.bincount(n, weights=third.sum(axis=1), minlength=len(cells)).astype(int)


def systems_of(cells: Sequence[object], tolerance: float = 1e-3) -> list[str]:
    """Systems of the lattices spanned by three rows each; ``tolerance`` is relative to the square of the longest reduced vector."""
    out, there, places = [UNKNOWN] * len(cells), [], []
    for i, cell in enumerate(cells):
        try:
            rows = np.array([list(r) for r in cell], dtype=float)
        except (TypeError, ValueError):
            continue
        if rows.shape == (3, 3) and np.isfinite(rows).all():
            there.append(rows)
            places.append(i)
    for lo in range(0, len(there), BLOCK):
        rows, at = np.array(there[lo : lo + BLOCK]), np.array(places[lo : lo + BLOCK])
        solid = np.abs(np.linalg.det(rows)) >= 1e-9 * np.maximum(1e-300, np.abs(rows).max(axis=(1, 2))) ** 3
        for i, n in zip(at[solid].tolist(), _kept(rows[solid], tolerance).tolist(), strict=True):
            out[i] = SYSTEMS.get(n, UNKNOWN)
    return out


def system_of(cell: object, tolerance: float = 1e-3) -> str:
    """``systems_of`` of one cell."""
    return systems_of([cell], tolerance)[0]


@F.pandas_udf(T.StringType())
def crystal_system(cells: pd.Series) -> pd.Series:
    """``systems_of`` three lattice vectors (array<array<double>>); a failure is a category of its own."""
    return pd.Series(systems_of(cells.tolist()), dtype=object)
