"""Structure equivalence as an explicit approximation, and the status of a match."""

from __future__ import annotations

from collections import Counter
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tolerances: lattice lengths by part, angles in degrees, sites as part of the free length for each atom.
LENGTHS, ANGLES, SITES = 0.2, 5.0, 0.3


def _cell(lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and angles of a lattice, both in ascending order."""
    lengths = np.linalg.norm(lattice, axis=1)
    cosines = [lattice[i] @ lattice[j] / lengths[i] / lengths[j] for i, j in ((1, 2), (0, 2), (0, 1))]
    return np.sort(lengths), np.sort(np.degrees(np.arccos(np.clip(cosines, -1, 1))))


def _matrix(rows) -> np.ndarray:
    return np.array([list(r) for r in rows], dtype=float)


def similar(a: dict, b: dict) -> bool:
    """Whether two structures (lattice 3x3, species, fractional coords) are alike.

    The same reduced composition and number of sites; cells alike after scaling to one
    volume for each atom; and, for some shift that lays an atom of the rarest species on
    another, every atom near one of its species. Neither cells are reduced nor supercells
    tried, so a true match in another setting is missed: take a precomputed status where
    one is at hand.
    """
    x, y = _matrix(a["lattice"]), _matrix(b["lattice"])
    p, q = _matrix(a["coords"]), _matrix(b["coords"])
    kinds, other = Counter(a["species"]), Counter(b["species"])
    scale = lambda c: {e: n // gcd(*c.values()) for e, n in c.items()}
    if p.shape != (sum(kinds.values()), 3) or q.shape != (sum(other.values()), 3):
        raise ValueError("coords")
    if not kinds or scale(kinds) != scale(other) or len(a["species"]) != len(b["species"]):
        return False
    n = len(a["species"])
    x, y = (m / (abs(np.linalg.det(m)) / n) ** (1 / 3) for m in (x, y))
    (lx, ax), (ly, ay) = _cell(x), _cell(y)
    if (np.abs(lx / ly - 1) > LENGTHS).any() or (np.abs(ax - ay) > ANGLES).any():
        return False
    sa, sb = np.asarray(a["species"]), np.asarray(b["species"])
    rare = min(kinds, key=lambda e: (kinds[e], e))
    mean = (x + y) / 2
    for target in q[sb == rare]:
        moved = p + (target - p[sa == rare][0])
        good = True
        for e in kinds:
            d = moved[sa == e][:, None] - q[sb == e][None]
            d -= np.round(d)
            far = np.linalg.norm(d @ mean, axis=2)
            if (far.min(axis=0) > SITES).any() or (far.min(axis=1) > SITES).any():
                good = False
                break
        if good:
            return True
    return False


STRUCTURE = T.StructType().add("lattice", T.ArrayType(T.ArrayType(T.DoubleType()))).add("species", T.ArrayType(T.StringType())).add("coords", T.ArrayType(T.ArrayType(T.DoubleType())))


@F.pandas_udf(T.StructType().add("matched", T.BooleanType()).add("error", T.StringType()))
def structure_match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Outcome of ``similar`` on two structure columns; what it raises becomes the error's name."""
    out = []
    for x, y in zip(a.to_dict("records"), b.to_dict("records"), strict=True):
        try:
            out.append((similar(x, y), None))
        except Exception as e:  # noqa: BLE001  a malformed structure is data
            out.append((None, type(e).__name__))
    return pd.DataFrame(out, columns=["matched", "error"])


def match_status(record_there: Column, outcome: Column) -> Column:
    """missing_record, match_error_<name>, strict_structure_match or structure_mismatch."""
    return F.when(~record_there, "missing_record").when(outcome["error"].isNotNull(), F.concat(F.lit("match_error_"), outcome["error"])).when(outcome["matched"], "strict_structure_match").otherwise("structure_mismatch")
