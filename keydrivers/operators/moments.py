"""Second moments of a feature design by fold, from a few aggregates over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VECTOR_INFIX
from ..spec import FeatureSpec
from .features import Slot, prepared
from .products import (
    COMPILED_WIDTH,
    column_stats,
    compiled_sums,
    pair_names,
    product_sums,
)


# Second moments that the driver may hold.
MOST_BYTES = 4 << 30


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred second moments of the slots and, last, of the target."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(
            n,
            self.mean + step * (other.n / n),
            self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n),
        )


@dataclass(frozen=True)
class DesignMoments:
    """The slots of a feature design and its moments in each fold."""

    slots: tuple[Slot, ...]
    by_fold: Mapping[int, Moments]
    # Categories that every row has, by whole counts.
    never_missing: frozenset[str] = frozenset()

    def total(self, without: int | None = None) -> Moments:
        """Moments of all rows, or of all rows outside one fold."""
        width = len(self.slots) + 1
        nothing = Moments(0.0, np.zeros(width), np.zeros((width, width)))
        return sum((m for f, m in self.by_fold.items() if f != without), nothing)


class LevelSum(NamedTuple):
    """Rows and, for a single level, sums of measures of one level or pair of levels."""

    fold: int
    n: int
    levels: tuple[tuple[int, str], ...]
    sums: tuple[float | None, ...]


def _grouped_sums(
    rows: DataFrame, spec: FeatureSpec, fold: str, products: Sequence[Column]
) -> pa.Table:
    """One scan: ``products`` by fold, by fold and level, and by fold and pair of levels.

    What reaches the driver, in columns, has a row for each fold and each level or pair of levels.
    """
    cats = list(spec.categorical)
    sets = [[fold, *some] for size in range(3) for some in combinations(cats, size)]
    found = rows.groupingSets(sets, fold, *cats).agg(
        *[F.grouping(c).alias(f"out{i}") for i, c in enumerate(cats)], *products
    )
    return found.toArrow()


def _level_sums(table: pa.Table, spec: FeatureSpec, fold: str) -> list[LevelSum]:
    cats = list(spec.categorical)
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    sums = [columns[f"s{i}"] for i in range(len(spec.measures))]
    listed = []
    for k in range(table.num_rows):
        levels = tuple(
            (i, columns[c][k]) for i, c in enumerate(cats) if columns[f"out{i}"][k] == 0
        )
        # A missing category has no slot.
        if levels and all(level is not None for _, level in levels):
            of_measures = tuple(s[k] for s in sums)
            listed.append(LevelSum(columns[fold][k], columns["n"][k], levels, of_measures))
    return listed


def _slots_of(levels: Mapping[tuple[int, str], int], spec: FeatureSpec) -> tuple[Slot, ...]:
    """Slots as the feature stages lay them out: levels by falling count, ties by name."""
    names = []
    for i, field in enumerate(spec.categorical):
        mine = sorted((-n, level) for (f, level), n in levels.items() if f == i)
        names += [(field + VECTOR_INFIX + level, field, level) for _, level in mine]
    names += [(c, c, None) for c in spec.numeric]
    return tuple(Slot(idx, *name) for idx, name in enumerate(names))


def design_moments(
    df: DataFrame, spec: FeatureSpec, fold: str | None = None, invalid: str = "error"
) -> DesignMoments:
    """Moments of the whole feature design (one fold without ``fold``), in two passes.

    The first gives means, the second sums products by fold, by level and by pair of levels. Designs
    with more than ``COMPILED_WIDTH`` measures take one more pass, as their products are summed by
    blocks. The driver holds folds x slots² numbers, so this is for designs of some thousand slots.
    """
    cats, measures = list(spec.categorical), list(spec.measures)
    key = fold or "__fold"
    rows = prepared(df if fold else df.withColumn(key, F.lit(0)), spec, invalid).select(
        key, *cats, *[F.col(c).cast("double").alias(c) for c in measures]
    )
    stats = column_stats(rows, measures)
    compiled = len(measures) <= COMPILED_WIDTH
    sums = compiled_sums(measures, stats.mean, products=compiled)
    grouped = _grouped_sums(rows, spec, key, sums)
    level_sums = _level_sums(grouped, spec, key)

    counts: dict[tuple[int, str], int] = {}
    for r in level_sums:
        if len(r.levels) == 1:
            counts[r.levels[0]] = counts.get(r.levels[0], 0) + r.n
    slots = _slots_of(counts, spec)
    p = len(slots)
    n_folds = len({r.fold for r in level_sums}) or 1
    needed = n_folds * (p + 1) ** 2 * 8
    if needed > MOST_BYTES:
        raise ValueError(
            f"{n_folds} folds of {p} slots take {needed / 1e9:.1f} GB on the driver: use method='gradient' or 'pipeline'"
        )
    # Where each measure stands: its slot, and for the target the place after all slots.
    place = {s.name: s.idx for s in slots}
    at = np.array([place[c] for c in spec.numeric] + [p])

    found: dict[int, Moments] = {}
    pairs = _pairs_by_fold(grouped, spec, key) if compiled else product_sums(
        rows, measures, stats, by=key
    ).collect()
    for r in pairs:
        m = found.setdefault(r[key], Moments(r["n"], np.zeros(p + 1), np.zeros((p + 1, p + 1))))
        i, j = at[r["i"]], at[r["j"]]
        m.mean[i], m.mean[j] = r["sx"] / r["n"], r["sy"] / r["n"]
        m.scatter[i, j] = m.scatter[j, i] = r["sxy"] - r["sx"] * r["sy"] / r["n"]
    _add_levels(found, level_sums, spec, slots, at)
    for m in found.values():
        m.mean[at] += np.array([stats.mean[c] for c in measures])
    present = [sum(n for (f, _), n in counts.items() if f == i) for i in range(len(cats))]
    never_missing = frozenset(c for c, n in zip(cats, present) if n == stats.rows)
    return DesignMoments(slots, found, never_missing)


def _pairs_by_fold(grouped: pa.Table, spec: FeatureSpec, fold: str) -> list[dict]:
    """Sums of products of the rows of each fold, a dictionary for each pair of measures."""
    outs = [f"out{i}" for i in range(len(spec.categorical))]
    whole = [r for r in grouped.to_pylist() if all(r[o] == 1 for o in outs)]
    return [
        {
            fold: r[fold],
            "i": i,
            "j": j,
            "n": float(r["n"]),
            "sx": r[f"s{i}"],
            "sy": r[f"s{j}"],
            "sxy": r[f"p{i}_{j}"],
        }
        for r in whole
        for i, j in pair_names(len(spec.measures))
        if r["n"]
    ]


def _add_levels(
    found: Mapping[int, Moments],
    level_sums: Sequence[LevelSum],
    spec: FeatureSpec,
    slots: Sequence[Slot],
    at: np.ndarray,
) -> None:
    """Fill in the dummy slots; the means of the measures still are differences from the centre."""
    dummy = {
        (spec.categorical.index(s.field), s.category): s.idx
        for s in slots
        if s.category is not None
    }
    for r in level_sums:
        m = found[r.fold]
        one = dummy[r.levels[0]]
        if len(r.levels) == 2:
            two = dummy[r.levels[1]]
            m.scatter[one, two] = m.scatter[two, one] = r.n
            continue
        m.mean[one] = r.n / m.n
        m.scatter[one, one] = r.n
        m.scatter[one, at] = m.scatter[at, one] = np.array(r.sums) - r.n * m.mean[at]
    places = np.array(sorted(dummy.values()), dtype=int)
    both = np.ix_(places, places)
    for m in found.values():
        m.scatter[both] -= m.n * np.outer(m.mean[places], m.mean[places])


def ridge_path(train: Moments, grid: tuple[float, ...]) -> list[tuple[float, np.ndarray]]:
    """(intercept, coefficients) for every penalty, from one decomposition.

    On standardised columns the penalty is the same for every slot, so the eigenvectors of the
    correlation matrix serve all penalties. Without a penalty, directions without spread are left
    out; predictions are those of any least-squares solution.
    """
    cov = train.scatter / train.n
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    # Sums around the mean carry rounding of this size, whatever the unit of the column.
    live = sd[:-1] > 1e-13 * np.abs(train.mean[:-1])
    sx, sy = sd[:-1][live], sd[-1]
    beta0 = np.zeros(len(sd) - 1)
    if sy == 0.0 or not live.any():
        return [(train.mean[-1], beta0) for _ in grid]
    values, vectors = np.linalg.eigh(cov[:-1, :-1][np.ix_(live, live)] / np.outer(sx, sx))
    turned = vectors.T @ (cov[:-1, -1][live] / (sx * sy))
    rank_floor = values.max() * len(values) * 1e-12
    fits = []
    for penalty in grid:
        divisor = values + penalty / sy
        keep = (values > rank_floor) if penalty == 0.0 else divisor > 0
        standardised = vectors @ np.where(keep, turned / np.where(keep, divisor, 1.0), 0.0)
        beta = beta0.copy()
        beta[live] = standardised * sy / sx
        fits.append((float(train.mean[-1] - train.mean[:-1] @ beta), beta))
    return fits


def held_out_metrics(
    test: Moments, intercept: float, beta: np.ndarray
) -> tuple[float | None, float]:
    """(r2, rmse) on held-out rows, from their moments."""
    weights = np.append(-beta, 1.0)
    bias = test.mean @ weights - intercept
    sse = float(weights @ test.scatter @ weights + test.n * bias * bias)
    sst = float(test.scatter[-1, -1])
    return (1.0 - sse / sst if sst > 0 else None), float(np.sqrt(max(sse, 0.0) / test.n))
