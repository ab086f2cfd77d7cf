"""Tables behind the usual charts: distributions, histograms, box plots, trends, scatter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unit_interval
from ..sources import checkpointed
from .quantiles import Quantiles, join_by_group, quantiles_by, seen_value

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("q1", "median", "q3")
# The usual length of box plot whiskers, in interquartile ranges.
WHISKER = 1.5


def distribution_by(
    df: DataFrame, category: str | Sequence[str], value: str, approx: bool = False
) -> DataFrame:
    """(category, n, mean, std, min, q1, median, q3, max) of the value in each category."""
    by = [category] if isinstance(category, str) else list(category)
    found = quantiles_by(df, value, QUARTILES, QUARTILE_NAMES, by, approx=approx)
    return found.table.select(*by, "n", "mean", "std", "min", "q1", "median", "q3", "max")


def histogram(
    df: DataFrame, col: str, lo: float | None = None, hi: float | None = None, bins: int = 20
) -> DataFrame:
    """(bin, lower, upper, n) for equal-width bins; empty bins are listed with n = 0.

    The last bin includes ``hi``. Values below ``lo`` are counted in bin 0 and values above
    ``hi`` in bin bins+1, so the counts always add up to the number of values. Limits that are
    not given are the least and greatest value. Nulls and NaN are no values.
    """
    v = seen_value(col)
    if lo is None or hi is None:
        ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        lo = ends["lo"] if lo is None else lo
        hi = ends["hi"] if hi is None else hi
    if lo is None or hi is None:
        raise ValueError(f"no value in {col}")
    width = (hi - lo) / bins if hi > lo else 1.0
    number = (
        F.when(v < lo, 0)
        .when(v > hi, bins + 1)
        .otherwise(F.least(F.floor((v - lo) / width) + 1, F.lit(bins)))
        .cast("int")
    )
    counted = (
        df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("filled"))
    )
    edges = df.sparkSession.range(bins + 2).select(F.col("id").cast("int").alias("bin"))
    inner = F.col("bin").between(1, bins)
    return (
        edges.join(counted, "bin", "left")
        .select(
            "bin",
            F.when(inner, F.lit(lo) + (F.col("bin") - 1) * F.lit(width))
            .when(F.col("bin") > bins, F.lit(float(hi)))
            .alias("lower"),
            F.when(F.col("bin") == bins, F.lit(float(hi)))
            .when(inner, F.lit(lo) + F.col("bin") * F.lit(width))
            .when(F.col("bin") == 0, F.lit(float(lo)))
            .alias("upper"),
            F.coalesce("filled", F.lit(0)).cast("bigint").alias("n"),
        )
        .where(inner | (F.col("n") > 0))
        .orderBy("bin")
    )


def _binning(bins: int):
    """The least exponent of a bin width, and for mapInArrow a task's counts under the least one of its values."""

    def exponent(least: float, greatest: float) -> int:
        """Of the widths 2 ** e under which at most ``bins`` bins hold all values, the least; bins are numbered
        exactly by a double."""
        largest = max(abs(least), abs(greatest))
        lowest = int(np.frexp(largest)[1]) - 53 if largest else 0
        span = greatest / 2 - least / 2
        e = max(lowest, int(np.frexp(span / bins)[1]) - 2 if span else lowest)
        while number(np.array([greatest]), e)[0] - number(np.array([least]), e)[0] >= bins:
            e += 1
        return e

    def number(values: np.ndarray, e: int) -> np.ndarray:
        found = np.floor(np.ldexp(values, -e))
        # What is too small for a double after scaling still lies below zero.
        return np.where((values < 0) & (found == 0), -1.0, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, e, least, greatest = {}, None, np.inf, -np.inf
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            values = values[np.isfinite(values)]
            if not len(values):
                continue
            least, greatest = min(least, values.min()), max(greatest, values.max())
            wider = exponent(float(least), float(greatest))
            if e is not None and wider != e:
                coarse = {}
                for cell, n in counts.items():
                    merged = float(number(np.array([cell]), wider - e)[0])
                    coarse[merged] = coarse.get(merged, 0) + n
                counts = coarse
            e = wider
            for cell, n in zip(*np.unique(number(values, e), return_counts=True), strict=True):
                counts[float(cell)] = counts.get(float(cell), 0) + int(n)
        if counts:
            size = len(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "e": pa.array([e] * size, pa.int32()),
                    "cell": list(counts),
                    "n": list(counts.values()),
                    "least": [float(least)] * size,
                    "greatest": [float(greatest)] * size,
                }
            )

    return exponent, number, run


def auto_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, n) without given limits, in one read: at most ``bins`` bins of equal width, the least power of two
    that does, with edges that are multiples of it; empty bins in between are listed with n = 0.

    Every task counts under the width that its values need so far and merges pairs of bins when one falls
    outside; tasks are merged under the width that all values need. So the result does not depend on
    order or partitions, and what is shuffled is ``bins`` rows for each task. Nulls, NaN and infinities are
    no values; without values there are no bins. An upper edge belongs to the next bin.
    """
    if bins < 2:
        raise ValueError("values on both sides of zero need two bins")
    exponent, number, run = _binning(bins)
    values = df.select(seen_value(col).alias("v")).where(F.col("v").isNotNull())
    parts = checkpointed(values.mapInArrow(run, "e int, cell double, n bigint, least double, greatest double"))
    ends = parts.agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).first()
    if ends["least"] is None:
        return parts.select(F.lit(0).alias("bin"), F.col("cell").alias("lower"), F.col("cell").alias("upper"), "n").limit(0)
    e = exponent(ends["least"], ends["greatest"])

    def scaled(cell: Column, shift: Column) -> Column:
        return F.floor(cell / F.pow(F.lit(2.0), shift)).cast("double")

    # In two steps, as a power of two that is no double would turn a number below zero into zero.
    shift = F.lit(e) - F.col("e")
    once = scaled(F.col("cell"), F.least(shift, F.lit(1000)))
    cell = scaled(once, F.greatest(shift - 1000, F.lit(0)))
    counted = parts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("filled"))
    first, last = (int(number(np.array([ends[c]]), e)[0]) for c in ("least", "greatest"))
    edges = df.sparkSession.range(last - first + 1).select(
        (F.col("id") + 1).cast("int").alias("bin"), (F.col("id") + F.lit(first)).cast("double").alias("cell")
    )
    width = F.lit(float(np.ldexp(1.0, e)))
    return (
        edges.join(counted, "cell", "left")
        .select(
            "bin",
            (F.col("cell") * width).alias("lower"),
            ((F.col("cell") + 1) * width).alias("upper"),
            F.coalesce("filled", F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("bin")
    )


def box_stats(
    df: DataFrame, col: str, by: str | Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Quartiles, whisker ends and outlier count of a box plot, overall or by category.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the box. The two reads of the
    quartiles keep what is needed for the whiskers.
    """
    by = [] if by is None else [by] if isinstance(by, str) else list(by)
    found = quantiles_by(df, col, QUARTILES, QUARTILE_NAMES, by, approx=approx, reach=WHISKER)
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    box = found.table.withColumn("lower_fence", F.col("q1") - reach).withColumn(
        "upper_fence", F.col("q3") + reach
    )
    cuts = [*QUARTILE_NAMES, "lower_fence", "upper_fence"]
    key = (F.struct(*by) if by else F.lit(0)).alias("g")
    if not approx:
        box = checkpointed(box)
        cells = found.cells.select("g", "n", "lo", "hi")
        if not _straddled(cells, box, key, found):
            return _whiskers(cells, box, by, cuts, key, found)
    rows = df.select(key, seen_value(col).alias("lo")).where(F.col("lo").isNotNull())
    rows = rows.select("g", F.lit(1).cast("bigint").alias("n"), "lo", F.col("lo").alias("hi"))
    return _whiskers(rows, box, by, cuts, key, found)


def _fenced(cells: DataFrame, box: DataFrame, key: Column, found: Quantiles) -> DataFrame:
    # One row for each group meets the cells, so counts are combined before any shuffle.
    side = box.select(key, "lower_fence", "upper_fence").withColumnRenamed("g", "ig")
    return join_by_group(cells, side, found.groups, found.sizes)


def _straddled(cells: DataFrame, box: DataFrame, key: Column, found: Quantiles) -> bool:
    """Whether a fence cuts through rows that were counted as a whole."""
    across = [(F.col("lo") < F.col(c)) & (F.col(c) <= F.col("hi")) for c in ("lower_fence",)]
    across += [(F.col("lo") <= F.col(c)) & (F.col(c) < F.col("hi")) for c in ("upper_fence",)]
    return bool(_fenced(cells.where("lo < hi"), box, key, found).where(across[0] | across[1]).take(1))


def _whiskers(
    cells: DataFrame, box: DataFrame, by: list[str], cuts: list[str], key: Column, found: Quantiles
) -> DataFrame:
    fenced = _fenced(cells, box, key, found)
    inside = (F.col("lo") >= F.col("lower_fence")) & (F.col("hi") <= F.col("upper_fence"))
    ends = fenced.groupBy("g").agg(
        F.min(F.when(inside, F.col("lo"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("hi"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("n_outliers"),
    )
    groups = box.select(key, F.struct(*by, *cuts, "n").alias("box"))
    outliers = F.coalesce("n_outliers", F.lit(0)).cast("bigint").alias("n_outliers")
    return groups.join(ends, "g", "left").select("box.*", "whisker_low", "whisker_high", outliers)


def yearly_average(df: DataFrame, year: str | Column, measures: Iterable[str]) -> DataFrame:
    """(year, n, avg_<measure> ...) in order of the year; a date or timestamp is cut to its year.

    Nulls and NaN are left out of the averages, but their rows are counted.
    """
    if isinstance(year, str):
        dated = df.schema[year].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        year = F.year(year) if dated else F.col(year)
    return (
        df.groupBy(year.alias("year"))
        .agg(
            F.count("*").alias("n"),
            *[F.avg(seen_value(m)).alias(f"avg_{m}") for m in measures],
        )
        .orderBy("year")
    )


def scatter_sample(
    df: DataFrame,
    x: str,
    y: str,
    fraction: float,
    keys: Sequence[str] | None = None,
    salt: str = "scatter-42",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Points of a scatter plot: a repeatable share of the rows, chosen by a hash of the key."""
    u = unit_interval(list(keys or df.columns), salt)
    return df.where(u < F.lit(fraction)).select(*extra, x, y)


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    n: int,
    keys: Sequence[str] | None = None,
    salt: str = "scatter-42",
    extra: Sequence[str] = (),
) -> DataFrame:
    """At most ``n`` points of a scatter plot: the rows with the least hash of the key.

    The same rows under any partitioning; a larger ``n`` adds points and keeps these. Every task keeps ``n`` rows, and
    these are merged, so neither the shuffle nor the chart grows with the table. Give a key that is
    unique for each row: rows with equal keys come in the order of x and y.
    """
    keys = list(keys or df.columns)
    u = unit_interval(keys, salt)
    rows = df.select(u.alias("__u"), F.struct(*keys).alias("__key"), *dict.fromkeys([*extra, x, y]))
    return rows.orderBy("__u", "__key", x, y).limit(n).drop("__u", "__key")
