"""Formula parsing on the executors, in Arrow batches, and fixed element groups."""

from __future__ import annotations

import re
from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element groups of the family table.
FAMILIES = {
    "transition_metal": "Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Tc Ru Rh Pd Ag Cd Hf Ta W Re Os Ir Pt Au Hg".split(),
    "lanthanide_actinide": "La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Ac Th Pa U Np Pu".split(),
    "alkali": "Li Na K Rb Cs Fr".split(),
    "alkaline_earth": "Be Mg Ca Sr Ba Ra".split(),
    "halogen": "F Cl Br I".split(),
    "chalcogen": "O S Se Te".split(),
    "pnictogen": "N P As Sb Bi".split(),
}
# Strata of the selection atlas.
STRATA = {
    "oxygen_containing": ["O"],
    "halogen_containing": FAMILIES["halogen"],
    "lanthanide_containing": "La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu".split(),
    "transition_metal_containing": FAMILIES["transition_metal"],
}

_TOKEN = re.compile(r"([A-Z][a-z]?)|([(\[{])|([)\]}])|(\d+(?:\.\d+)?)")


def parse(formula: str) -> dict[str, float]:
    """Amount of each element; nested brackets multiply. Raises ValueError on anything else."""
    stack: list[dict[str, float]] = [{}]
    last: dict[str, float] | None = None
    at = 0
    for m in _TOKEN.finditer(formula):
        if m.start() != at:
            break
        at = m.end()
        symbol, opening, closing, number = m.groups()
        if number is not None:
            if last is None:
                raise ValueError(formula)
            for e, n in last.items():  # the unit counted once already
                stack[-1][e] += n * (float(number) - 1)
            last = None
        elif opening:
            stack.append({})
            last = None
        else:
            if symbol:
                last = {symbol: 1.0}
            elif len(stack) > 1:
                last = stack.pop()
            else:
                raise ValueError(formula)
            for e, n in last.items():
                stack[-1][e] = stack[-1].get(e, 0.0) + n
    if at != len(formula) or len(stack) != 1 or not stack[0]:
        raise ValueError(formula)
    return stack[0]


def _number(x: float) -> str:
    return "" if x == 1 else str(int(x)) if float(x).is_integer() else f"{x:g}"


def reduce_amounts(amounts: dict[str, float]) -> dict[str, float]:
    """Amounts divided by their greatest common divisor, where all are whole."""
    if all(float(n).is_integer() and n > 0 for n in amounts.values()):
        d = reduce(gcd, (int(n) for n in amounts.values()))
        return {e: n / d for e, n in amounts.items()}
    return dict(amounts)


def reduced_text(formula: str | None) -> str | None:
    """Reduced formula, elements in alphabetical order; the input itself where it can't be parsed."""
    if formula is None:
        return None
    try:
        return "".join(e + _number(n) for e, n in sorted(reduce_amounts(parse(formula)).items()))
    except ValueError:
        return formula


def anonymous_text(formula: str | None) -> str | None:
    """Reduced amounts in ascending order under the letters A, B, C...; null where it can't be parsed."""
    try:
        amounts = sorted(reduce_amounts(parse(formula or "")).values())
    except ValueError:
        return None
    return "".join(chr(65 + i) + _number(n) for i, n in enumerate(amounts))


@F.pandas_udf(T.StringType())
def reduced_formula(c: pd.Series) -> pd.Series:
    return c.map(reduced_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def anonymous_formula(c: pd.Series) -> pd.Series:
    return c.map(anonymous_text, na_action="ignore")


def _amounts(formula: str | None) -> dict[str, float] | None:
    try:
        return parse(formula or "")
    except ValueError:
        return None


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def composition(c: pd.Series) -> pd.Series:
    """Amounts by element; null where the formula can't be parsed."""
    return c.map(_amounts)


def parse_sites(sites: list[str] | None) -> tuple[list[str], list[list[float]]] | None:
    """Species and coordinates of ``El @ x y z`` strings; null if any is malformed."""
    try:
        split = [s.split("@", 1) for s in sites or []]
        points = [[float(x) for x in p.split()] for _, p in split]
        if not split or any(len(p) != 3 for p in points):
            return None
        return [e.strip() for e, _ in split], points
    except (ValueError, AttributeError):
        return None


@F.pandas_udf(T.StructType().add("species", T.ArrayType(T.StringType())).add("coords", T.ArrayType(T.ArrayType(T.DoubleType()))))
def site_structure(c: pd.Series) -> pd.DataFrame:
    found = [parse_sites(None if s is None else list(s)) for s in c]
    return pd.DataFrame({"species": [f and f[0] for f in found], "coords": [f and f[1] for f in found]})
