"""Linear and ridge models of designs with very many slots, by conjugate gradients.

The normal equations are never formed: a step needs them times a vector, which is one aggregate over the rows,
by level, of what the vector predicts for them. The driver holds a few numbers for each slot and penalty, and
all penalties share each pass. On standardised columns the steps begin at zero, so without a penalty they lead to
the solution of least norm, as the pseudo-inverse gives it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import VECTOR_INFIX
from ..sources import kept, result_schema, rows_to_frame
from ..spec import FeatureSpec
from . import levels
from .features import Slot, prepared
from .products import column_stats

TOLERANCE = 1e-11
MOST_STEPS = 500


class _Design:
    """The rows of a design, centred, and its slots with their counts."""

    def __init__(self, rows: DataFrame, spec: FeatureSpec, mean: dict[str, float]):
        self.spec, self.cats, self.numeric = spec, list(spec.categorical), list(spec.numeric)
        measures = [(F.col(c).cast("double") - F.lit(mean[c])).alias(c) for c in spec.measures]
        self.rows = rows.select(*self.cats, *measures)
        self.place: list[dict[str, int]] = [{} for _ in self.cats]

    def sums(self, rows: DataFrame, values: Sequence[Column]) -> pa.Table:
        """``values`` summed over all rows and by each level of each category: a row for each slot."""
        sets = [[], *[[c] for c in self.cats]]
        flags = [F.grouping(c).alias(f"out{i}") for i, c in enumerate(self.cats)]
        return rows.groupingSets(sets, *self.cats).agg(*flags, *values).toArrow()

    def split(self, table: pa.Table) -> tuple[int, list[tuple[list[str], np.ndarray]]]:
        """The row of all rows, and for each category its levels with their rows; missing levels have no slot."""
        out = [np.asarray(table.column(f"out{i}")) for i in range(len(self.cats))]
        whole = np.flatnonzero(np.all(out, axis=0)) if out else np.array([0])
        found = []
        for i, c in enumerate(self.cats):
            names = table.column(c).to_pylist()
            at = [int(k) for k in np.flatnonzero(out[i] == 0) if names[k] is not None]
            found.append(([names[k] for k in at], np.array(at, dtype=int)))
        return int(whole[0]), found

    def number(self, counted: list[tuple[list[str], np.ndarray]]) -> tuple[Slot, ...]:
        """Slots as the feature stages lay them out: levels by falling count, ties by name."""
        slots: list[Slot] = []
        for i, (names, n) in enumerate(counted):
            for k in sorted(range(len(names)), key=lambda k: (-n[k], names[k])):  # noqa: B023
                self.place[i][names[k]] = len(slots)
                slots.append(Slot(len(slots), self.cats[i] + VECTOR_INFIX + names[k], self.cats[i], names[k]))
        for c in self.numeric:
            slots.append(Slot(len(slots), c, c, None))
        return tuple(slots)

    def times(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For vectors by slot and column: the design's transpose times the design times them, and the sums of
        their predictions. One pass."""
        width, first = vectors.shape[1], len(vectors) - len(self.numeric)
        rows = self.rows.withColumn("__hash", F.xxhash64(*self.rows.columns))
        made = [F.lit(0.0) for _ in range(width)]
        for i, c in enumerate(self.cats):
            names = [f"__e{i}_{k}" for k in range(width)]
            schema = result_schema(level=T.StringType(), **{n: T.DoubleType() for n in names})
            listed = [(name, *map(float, vectors[at])) for name, at in self.place[i].items()]
            hot = rows_to_frame(rows.sparkSession, listed[: levels.HOT_LEVELS], schema)
            rest = listed[levels.HOT_LEVELS :]
            cold = rows_to_frame(rows.sparkSession, rest, schema) if rest else None
            rows = levels.joined_levels(rows, c, hot, cold, names, F.col("__hash"))
            made = [m + F.coalesce(F.col(n), F.lit(0.0)) for m, n in zip(made, names, strict=True)]
        for j, c in enumerate(self.numeric):
            made = [m + F.col(c) * F.lit(float(vectors[first + j, k])) for k, m in enumerate(made)]
        rows = rows.select(*self.cats, *self.numeric, *[m.alias(f"__p{k}") for k, m in enumerate(made)])
        sums = [F.sum(f"__p{k}").alias(f"p{k}") for k in range(width)]
        sums += [F.sum(F.col(f"__p{k}") * F.col(c)).alias(f"p{k}x{j}") for k in range(width) for j, c in enumerate(self.numeric)]
        table = self.sums(rows, sums)
        whole, found = self.split(table)
        result = np.zeros_like(vectors)
        predicted = np.column_stack([np.asarray(table.column(f"p{k}")) for k in range(width)])
        for i, (names, at) in enumerate(found):
            result[[self.place[i][name] for name in names]] = predicted[at]
        for k in range(width):
            for j in range(len(self.numeric)):
                result[first + j, k] = table.column(f"p{k}x{j}")[whole].as_py() or 0.0
        return result, predicted[whole]


def gradient_path(
    df: DataFrame, spec: FeatureSpec, grid: Sequence[float], invalid: str = "error"
) -> tuple[tuple[Slot, ...], list[tuple[float, np.ndarray]], np.ndarray, frozenset[str]]:
    """Slots, (intercept, coefficients) for each penalty, spreads of slots and target, and the categories that every row has."""
    rows = prepared(df.select(*spec.columns), spec, invalid)
    mean = column_stats(rows.select([F.col(c).cast("double").alias(c) for c in spec.measures]), spec.measures).mean
    design = _Design(rows, spec, dict(mean))
    with kept(design.rows) as held:
        design.rows = held
        y = F.col(spec.target)
        values = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
        for j, c in enumerate(design.numeric):
            x = F.col(c)
            values += [F.sum(x).alias(f"sx{j}"), F.sum(x * x).alias(f"sxx{j}"), F.sum(x * y).alias(f"sxy{j}")]
        table = design.sums(held, values)
        whole, found = design.split(table)
        column = {c: np.asarray(table.column(c)) for c in table.column_names if c not in design.cats}
        slots = design.number([(names, column["n"][at]) for names, at in found])
        n, p = float(column["n"][whole]), len(slots)
        if not n:
            raise ValueError("no rows to fit")
        centre, square, cross = np.zeros(p), np.zeros(p), np.zeros(p)
        y_mean = column["sy"][whole] / n
        for i, (names, at) in enumerate(found):
            place = [design.place[i][name] for name in names]
            centre[place] = square[place] = column["n"][at] / n
            cross[place] = column["sy"][at] / n
        for j in range(len(design.numeric)):
            k = p - len(design.numeric) + j
            centre[k], square[k], cross[k] = (column[f"{s}{j}"][whole] / n for s in ("sx", "sxx", "sxy"))
        variance = np.clip(square - centre * centre, 0.0, None)
        sx, sy = np.sqrt(variance), float(np.sqrt(max(column["syy"][whole] / n - y_mean * y_mean, 0.0)))
        scale = np.array([abs(mean[s.name]) if s.category is None else 1.0 for s in slots])
        live = sx > 1e-13 * scale
        spread = np.append(sx, sy) * np.sqrt(n / max(n - 1.0, 1.0))
        means = centre + np.array([mean[s.name] if s.category is None else 0.0 for s in slots])
        target_mean = y_mean + mean[spec.target]
        full = frozenset(
            c for i, c in enumerate(design.cats) if column["n"][found[i][1]].sum() == column["n"][whole]
        )
        if sy == 0.0 or not live.any():
            return slots, [(target_mean, np.zeros(p)) for _ in grid], spread, full
        divisor = np.where(live, sx, 1.0)
        goal = np.where(live, (cross - centre * y_mean) / (divisor * sy), 0.0)

        def correlations(vectors: np.ndarray) -> np.ndarray:
            unscaled = np.where(live[:, None], vectors / divisor[:, None], 0.0)
            product, total = design.times(unscaled)
            moved = product / n - np.outer(centre, total / n)
            return np.where(live[:, None], moved / divisor[:, None], 0.0)

        solved = _conjugate_gradients(correlations, goal, np.array([g / sy for g in grid]))
    fits = []
    for k in range(len(grid)):
        beta = np.where(live, solved[:, k] * sy / divisor, 0.0)
        fits.append((float(target_mean - means @ beta), beta))
    return slots, fits, spread, full


def _conjugate_gradients(times, goal: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Solve (R + penalty) z = goal for every penalty side by side; ``times`` multiplies columns by R."""
    solved = np.zeros((len(goal), len(penalties)))
    rest = np.repeat(goal[:, None], len(penalties), 1)
    step = rest.copy()
    size = (rest * rest).sum(0)
    wanted = TOLERANCE**2 * size
    for _ in range(MOST_STEPS):
        on = np.flatnonzero(size > wanted)
        if not len(on):
            return solved
        product = times(step[:, on]) + step[:, on] * penalties[on]
        bend = (step[:, on] * product).sum(0)
        # Along a direction without spread there is nothing to gain.
        length = np.where(bend > 0, size[on] / np.where(bend > 0, bend, 1.0), 0.0)
        solved[:, on] += step[:, on] * length
        rest[:, on] -= product * length
        new = np.where(bend > 0, (rest[:, on] ** 2).sum(0), 0.0)
        step[:, on] = rest[:, on] + step[:, on] * (new / size[on])
        size[on] = new
    raise ValueError(f"no solution to {TOLERANCE:g} after {MOST_STEPS} steps: predictors are nearly collinear, use a penalty")
