"""Energy above the hull of competing phases, one small linear programme per target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fractions(amounts: Mapping[str, float]) -> dict[str, float]:
    total = sum(amounts.values())
    return {e: n / total for e, n in amounts.items()}


class Hull:
    """The lower hull of competing phases over one set of elements, asked for many compositions.

    Revised simplex in two phases with Bland's rule, on fractions of atoms. Costs don't depend on the composition, so a
    basis that was optimal for one is optimal for every other it can make up: those found are tried first.
    """

    def __init__(self, elements: Sequence[str], phases: Sequence[tuple[Mapping[str, float], float]]) -> None:
        self.elements = sorted(elements)
        usable = [(f, e) for f, e in ((fractions(p), e) for p, e in phases) if set(f) <= set(self.elements)]
        self.ends = {next(iter(f)) for f, _ in usable if len(f) == 1}
        a = np.array([[f.get(e, 0.0) for f, _ in usable] for e in self.elements]).reshape(len(self.elements), len(usable))
        self.n = len(usable)
        self.full, self.cost = np.hstack((a, np.eye(len(self.elements)))), np.array([e for _, e in usable] + [0.0] * len(self.elements))
        self.known: list[tuple[np.ndarray, np.ndarray]] = []

    def energy(self, composition: Mapping[str, float]) -> float | None:
        """Least energy per atom of a mixture with this composition; None if none has it."""
        if not self.n or not set(composition) <= set(self.elements):
            return None
        part = fractions(composition)
        b = np.array([part.get(e, 0.0) for e in self.elements])
        for inverse, cost in self.known:
            x = inverse @ b
            if (x >= -1e-12).all():
                return float(cost @ x)
        basis = self._solve(b)
        if basis is None:
            return None
        inverse = np.linalg.pinv(self.full[:, basis])
        if all(j < self.n for j in basis):
            self.known.append((inverse, self.cost[basis]))
        return float(self.cost[basis] @ (inverse @ b))

    def _solve(self, b: np.ndarray) -> list[int] | None:
        n, full = self.n, self.full
        basis = list(range(n, full.shape[1]))
        for cost in (np.concatenate((np.zeros(n), np.ones(len(b)))), self.cost):
            first = cost is not self.cost
            for _ in range(1000):
                inverse = np.linalg.pinv(full[:, basis])
                x = inverse @ b
                price = cost - (cost[basis] @ inverse) @ full
                enter = next((j for j in range(n) if j not in basis and price[j] < -1e-10), None)
                if enter is None:
                    break
                d = inverse @ full[:, enter]
                ratios = [(x[i] / d[i], basis[i], i) for i in range(len(b)) if d[i] > 1e-12]
                if not ratios:
                    break
                basis[min(ratios)[2]] = enter
            if first:
                if cost[basis] @ (np.linalg.pinv(full[:, basis]) @ b) > 1e-9:
                    return None
                for i, j in enumerate(basis):  # drive idle artificial columns out where a phase can stand in
                    if j >= n:
                        row = np.linalg.pinv(full[:, basis])[i] @ full[:, :n]
                        swap = next((k for k in range(n) if k not in basis and abs(row[k]) > 1e-9), None)
                        if swap is not None:
                            basis[i] = swap
        return basis


def lowest_energy(target: Mapping[str, float], phases: Sequence[tuple[Mapping[str, float], float]]) -> float | None:
    """Least energy per atom of a mixture of phases with the target's composition; None if none has it."""
    return Hull(sorted(target), phases).energy(target)


def system_hulls(targets: DataFrame, phases: DataFrame, system: str, amounts: str, energy: str) -> DataFrame:
    """``targets`` with e_above_hull and reason, against all ``phases`` of their system, themselves included.

    A hull depends on compositions and on the least energy of each, so both sides are reduced to those first, and only
    distinct compositions of a system meet in a task, in one ``Hull`` for each set of elements; targets join their composition's energy
    afterwards. Compositions are keyed by their atomic fractions to nine digits. A null or empty composition, or a null
    energy, gives null with reason ``no_composition``, an element without a phase of its own ``missing_end_member``.
    """
    shares = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda x: F.struct(x["key"].alias("e"), (x["value"] / F.aggregate(F.map_values(m), F.lit(0.0), lambda a, b: a + b)).alias("f")))
    keyed = lambda df: df.withColumn("_shares", F.when(F.size(amounts) > 0, shares(F.col(amounts)))).withColumn("_key", F.concat_ws(";", F.transform("_shares", lambda x: F.concat(x["e"], F.lit(":"), F.format_string("%.9f", x["f"])))))
    named, rivals = keyed(targets), keyed(phases)
    least = rivals.where(F.col("_shares").isNotNull() & F.col(energy).isNotNull()).groupBy(system, "_key").agg(F.first("_shares").alias("shares"), F.min(energy).cast("double").alias("energy"))
    asked = named.where(F.col("_shares").isNotNull()).groupBy(system, "_key").agg(F.first("_shares").alias("shares"))
    kind = targets.schema[system].dataType.simpleString()

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        read = lambda shares: {x["e"]: float(x["f"]) for x in shares}
        known = [(read(s), float(e)) for s, e in zip(right["shares"], right["energy"], strict=True)]
        hulls: dict[tuple, Hull] = {}
        out = []
        for name, shares in zip(left["_key"], left["shares"], strict=True):
            part = read(shares)
            own = hulls.setdefault(tuple(sorted(part)), Hull(sorted(part), known))
            missing = not set(part) <= own.ends
            out.append((key[0], name, None if missing else own.energy(part), "missing_end_member" if missing else "ok"))
        return pd.DataFrame(out, columns=["_of", "_name", "_low", "_reason"])

    low = asked.groupBy(system).cogroup(least.groupBy(system)).applyInPandas(run, f"_of {kind}, _name string, _low double, _reason string")
    found = named.join(low, F.col(system).eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_name")), "left")
    above = F.greatest(F.lit(0.0), F.col(energy) - F.col("_low"))
    reason = F.when(F.col("_shares").isNull() | F.col(energy).isNull(), "no_composition").otherwise(F.coalesce("_reason", F.lit("missing_end_member")))
    return found.select(*targets.columns, F.when(F.col(energy).isNotNull() & F.col("_low").isNotNull(), above).alias("e_above_hull"), reason.alias("reason"))


def above_hull(targets: DataFrame, phases: DataFrame) -> DataFrame:
    """(target_id, e_above_hull, reason) from targets (target_id, amounts, energy) and phases (target_id, amounts, energy).

    Phases are the competitors of each target, few by nature; the target competes too. A
    missing end member gives null with a reason.
    """

    def run(key: tuple, target: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in target.itertuples():
            amounts = dict(t.amounts)
            found = [(dict(a), float(e)) for a, e in zip(rows["amounts"], rows["energy"], strict=True)]
            ends = {next(iter(p)) for p, _ in found if len(p) == 1}
            if not set(amounts) <= ends and len(amounts) > 1:
                out.append((key[0], None, "missing_end_member"))
                continue
            low = lowest_energy(amounts, [*found, (amounts, float(t.energy))])
            out.append((key[0], None if low is None else max(0.0, float(t.energy) - low), "ok" if low is not None else "no_hull"))
        return pd.DataFrame(out, columns=["target_id", "e_above_hull", "reason"])

    return targets.groupBy("target_id").cogroup(phases.groupBy("target_id")).applyInPandas(run, "target_id string, e_above_hull double, reason string")


def on_hull(e: F.Column, tolerance: float = 1e-8) -> F.Column:
    return e <= F.lit(tolerance)
