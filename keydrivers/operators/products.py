"""Sums of products of numeric columns: the raw material of correlations and linear fits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to here one aggregate over all pairs stays small enough for the JVM to compile. For more
# columns each task multiplies blocks of rows as matrices instead.
COMPILED_WIDTH = 12

_NAMES = ("n", "sx", "sy", "sxx", "syy", "sxy")


@dataclass(frozen=True)
class ColumnStats:
    """What one light pass tells about the columns: a few numbers for each."""

    rows: int
    count: Mapping[str, int]
    mean: Mapping[str, float]
    flat: frozenset[str]

    @property
    def complete(self) -> bool:
        return all(c == self.rows for c in self.count.values())


def column_stats(df: DataFrame, cols: Sequence[str]) -> ColumnStats:
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(cols)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)],
    ).first()
    return ColumnStats(
        rows=row["rows"],
        count={c: row[f"n{i}"] for i, c in enumerate(cols)},
        mean={c: float(row[f"mean{i}"] or 0.0) for i, c in enumerate(cols)},
        flat=frozenset(c for i, c in enumerate(cols) if row[f"lo{i}"] == row[f"hi{i}"]),
    )


def pair_names(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def compiled_sums(cols: Sequence[str], mean: Mapping[str, float], products: bool = True):
    """Aggregates n, s<i> and p<i>_<j>: rows, sums and sums of products around the means."""
    x = [F.col(c) - F.lit(mean[c]) for c in cols]
    return [
        F.count("*").alias("n"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(len(cols))],
        *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pair_names(len(cols)) if products],
    ]


def listed_pairs(sums: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    """The columns of ``compiled_sums`` as one row for each pair."""
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.col("n").cast("double").alias("n"),
            F.col(f"s{i}").alias("sx"),
            F.col(f"s{j}").alias("sy"),
            F.col(f"p{i}_{i}").alias("sxx"),
            F.col(f"p{j}_{j}").alias("syy"),
            F.col(f"p{i}_{j}").alias("sxy"),
        )
        for i, j in pair_names(width)
    ]
    return sums.select(*by, F.inline(F.array(*cells)))


def _task_sums(width: int, mean: np.ndarray):
    """For mapInArrow: the sums of all pairs over one task's rows, by group number."""
    upper_i, upper_j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns[1:]]
            )
            x -= mean
            for g in np.unique(groups):
                rows = x[groups == g]
                sums = found.setdefault(int(g), np.zeros((4, width, width)))
                sums[0] += len(rows)
                sums[1] += rows.sum(0)[:, None]
                sums[2] += (rows * rows).sum(0)[:, None]
                sums[3] += rows.T @ rows
        for g, (n, sx, sxx, sxy) in found.items():
            values = (n, sx, sx.T, sxx, sxx.T, sxy)
            yield pa.RecordBatch.from_pydict(
                {
                    "g": np.full(len(upper_i), g, dtype="int32"),
                    "i": upper_i.astype("int32"),
                    "j": upper_j.astype("int32"),
                    **{k: v[upper_i, upper_j] for k, v in zip(_NAMES, values)},
                }
            )

    return run


def _in_blocks(df: DataFrame, cols: Sequence[str], mean: Mapping[str, float], by: list[str]):
    centre = np.array([mean[c] for c in cols])
    group = F.col(by[0]).cast("int") if by else F.lit(0)
    schema = "g int, i int, j int, " + ", ".join(f"{k} double" for k in _NAMES)
    sums = (
        df.select(group.alias("g"), *cols)
        .mapInArrow(_task_sums(len(cols), centre), schema)
        .groupBy("g", "i", "j")
        .agg(*[F.sum(k).alias(k) for k in _NAMES])
    )
    return sums.withColumnRenamed("g", by[0]) if by else sums.drop("g")


def product_sums(
    df: DataFrame,
    cols: Sequence[str],
    stats: ColumnStats,
    by: str | None = None,
    compiled_width: int = COMPILED_WIDTH,
) -> DataFrame:
    """(by, i, j, n, sx, sy, sxx, syy, sxy) for each pair i <= j of double columns without gaps.

    Values are taken as differences from the column mean, which keeps the sums accurate. ``by`` is
    a column of small whole numbers. What is shuffled is one table of pairs for each task, whatever
    the number of rows.
    """
    groups = [by] if by else []
    if stats.complete and len(cols) <= compiled_width:
        sums = df.groupBy(*groups).agg(*compiled_sums(cols, stats.mean))
        return listed_pairs(sums, len(cols), groups)
    return _in_blocks(df, cols, stats.mean, groups)


def _task_moments(width: int):
    """For mapInArrow: n, means and centred products of all pairs over one task's rows, gaps left out.

    Each batch gives all pairs as four matrix products around the means of its columns. Where the rows of a
    pair lie so far from these that digits would be lost, that pair is taken from its own rows. Batches are
    merged by Chan's rule.
    """
    upper_i, upper_j = np.triu_indices(width)

    def of_batch(x: np.ndarray) -> list[np.ndarray]:
        there = ~np.isnan(x)
        mask = there.astype("float64")
        count = mask.sum(0)
        shift = np.where(there, x, 0.0).sum(0) / np.maximum(count, 1.0)
        z = np.where(there, x - shift, 0.0)
        n = mask.T @ mask
        sx = z.T @ mask
        sxx = (z * z).T @ mask
        some = np.maximum(n, 1.0)
        m = sx / some
        cxx = np.maximum(sxx - sx * m, 0.0)
        cxy = z.T @ z - sx * m.T
        mean = shift[:, None] + m
        poor = (n > 1) & (cxx < 1e-6 * sxx)
        for i, j in np.argwhere(np.triu(poor | poor.T)):
            both = there[:, i] & there[:, j]
            a, b = x[both, i], x[both, j]
            mean[i, j], mean[j, i] = a.mean(), b.mean()
            a, b = a - mean[i, j], b - mean[j, i]
            cxx[i, j], cxx[j, i] = a @ a, b @ b
            cxy[i, j] = cxy[j, i] = a @ b
        return [n, mean, cxx, cxy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, cxx, cxy = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]
            )
            more, mean_b, cxx_b, cxy_b = of_batch(x)
            total = np.maximum(n + more, 1.0)
            step = np.where(more > 0, mean_b - mean, 0.0)
            weight = n * more / total
            cxx += cxx_b + step * step * weight
            cxy += cxy_b + step * step.T * weight
            mean += step * more / total
            n = n + more
        found = {"n": n, "mx": mean, "my": mean.T, "cxx": cxx, "cyy": cxx.T, "cxy": cxy}
        yield pa.RecordBatch.from_pydict(
            {
                "i": upper_i.astype("int32"),
                "j": upper_j.astype("int32"),
                **{k: v[upper_i, upper_j] for k, v in found.items()},
            }
        )

    return run


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, mx, my, cxx, cyy, cxy) for each pair i <= j of double columns over the rows that have both.

    ``mx`` is the mean of column i over these rows, ``cxy`` the sum of products around the means. One pass; what is
    shuffled is one table of pairs for each task. Tasks are merged around the common mean of the pair.
    """
    schema = "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"
    tasks = df.select(*cols).mapInArrow(_task_moments(len(cols)), schema)
    pair = Window.partitionBy("i", "j")

    def common(mean: str):
        return F.try_divide(F.sum(F.col("n") * F.col(mean)).over(pair), F.sum("n").over(pair))

    tasks = tasks.withColumns({"dx": F.col("mx") - common("mx"), "dy": F.col("my") - common("my")})
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    return tasks.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(n * F.col("mx")), F.sum("n")).alias("mx"),
        F.try_divide(F.sum(n * F.col("my")), F.sum("n")).alias("my"),
        F.sum(F.col("cxx") + F.coalesce(n * dx * dx, F.lit(0.0))).alias("cxx"),
        F.sum(F.col("cyy") + F.coalesce(n * dy * dy, F.lit(0.0))).alias("cyy"),
        F.sum(F.col("cxy") + F.coalesce(n * dx * dy, F.lit(0.0))).alias("cxy"),
    )
