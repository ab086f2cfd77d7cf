"""Exact quantiles by group from two reads of the rows, without gathering a group in one task.

The first read takes count, moments and a random sample of bounded size for each group; the sample gives a
bracket around each wanted rank that holds it but for one case in 100,000. The second read counts the rows
between the brackets and keeps the values inside, with their number. The counts prove for each rank
that its bracket holds it; for one that does not, the rows are read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources import checkpointed

# So many rows of an interval may be ranked inside one task.
ROWS_IN_ONE_TASK = 1_000_000
LARGEST = 1.7976931348623157e308
# Parts that each pass cuts an interval into.
CELLS = 4096
# Rows with one entry for each group (about 100 bytes each) that may be sent to every executor.
BROADCAST_ROWS = 100_000


# Rows in the sample of a group; half the width of a bracket in standard deviations of a sample's rank.
SAMPLE = 16_384
DEVIATIONS = 4.5


@dataclass(frozen=True)
class Quantiles:
    """Quantiles by group with n, mean, std, min and max; the number of groups, and their sizes as
    (g, n) with g a struct; and the rows in ``cells`` (g, region, v, n, lo, hi): values inside a bracket one by
    one, stretches between brackets (v null) as a whole."""

    table: DataFrame
    groups: int
    sizes: DataFrame
    cells: DataFrame | None = None


MOMENTS = ("n", "mean", "std", "min", "max")


def join_by_group(
    rows: DataFrame,
    side: DataFrame,
    side_rows: int,
    sizes: DataFrame,
    most: int = 1,
    condition: Column | None = None,
) -> DataFrame:
    """Join ``rows`` by their group ``g`` to at most ``most`` rows of ``side`` by group ``ig``.

    A small side is broadcast. Of a larger one, the rows of large groups are: if a group is large
    that has more than its share of the rows, there are few of them, so what is broadcast is
    bounded, and what is shuffled has no hot group.
    """
    same = F.col("g") == F.col("ig")
    if condition is not None:
        same = same & condition
    if side_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), same)
    total = sizes.agg(F.sum("n")).first()[0]
    # Fewer groups than BROADCAST_ROWS / most can be above this size.
    share = total * most / BROADCAST_ROWS
    large = sizes.where(F.col("n") > share).select(F.col("g").alias("large"))
    of_large = F.col("ig") == F.col("large")
    hot = side.join(F.broadcast(large), of_large, "left_semi")
    cold = side.join(F.broadcast(large), of_large, "left_anti")
    rest = rows.join(F.broadcast(large), F.col("g") == F.col("large"), "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(rest.join(cold, same))


def seen_value(value: str) -> Column:
    """The column as double, with NaN as null."""
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def _key(by: Sequence[str]) -> Column:
    # As a struct, a group of nulls equals itself.
    return F.struct(*[F.col(b).alias(b) for b in by])


def _within(
    values: DataFrame, intervals: DataFrame, size: Row, sizes: DataFrame | None
) -> DataFrame:
    """Rows that lie in one of the intervals of their group; the intervals do not overlap."""
    v = F.col("v")
    if sizes is None:
        # One group, with at most two intervals for each quantile.
        spans = [
            F.when(
                v.between(r["lo"], r["hi"]),
                F.struct(
                    F.lit(r["lo"]).alias("lo"),
                    F.lit(r["hi"]).alias("hi"),
                    F.lit(r["below"]).cast("bigint").alias("below"),
                ),
            )
            for r in intervals.select("lo", "hi", "below").collect()
        ]
        return values.withColumn("span", F.coalesce(*spans)).where("span is not null").select(
            "g", "v", "w", "span.*"
        )
    side = intervals.select(F.col("g").alias("ig"), "lo", "hi", "below")
    inside = v.between(F.col("lo"), F.col("hi"))
    return join_by_group(values, side, size["n"], sizes, size["ranks"], inside).drop("ig")


def _pick(cells: DataFrame, intervals: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """For every wanted rank the cell that holds it; cells of an interval are a bounded list."""
    in_order = Window.partitionBy("g", "lo").orderBy("c_lo")
    placed = cells.withColumn("upto", F.col("below") + F.sum("n").over(in_order)).withColumn(
        "before", F.col("upto") - F.col("n")
    )
    wanted = intervals.select("g", "lo", F.explode("ranks").alias("rank"))
    hit = placed.join(wanted, ["g", "lo"]).where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))
    )
    return hit.groupBy(
        "g",
        F.col("c_lo").alias("lo"),
        F.col("c_hi").alias("hi"),
        F.col("before").alias("below"),
        F.col("n").alias("inside"),
        *also,
    ).agg(F.collect_set("rank").alias("ranks"))


def _narrowed(
    values: DataFrame, intervals: DataFrame, size: Row, sizes: DataFrame | None
) -> DataFrame:
    """One pass: count rows by equal parts of each interval and keep the parts with a rank.

    Infinities have parts of their own. The ends of an interval are values, and fall into different
    parts, so every pass makes it smaller.
    """

    def finite(c: str) -> Column:
        return F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST))

    width = finite("hi") - finite("lo")
    # Of an interval that is too wide for a number, take halves.
    halves = (finite("v") / 2 - finite("lo") / 2) / (finite("hi") / 2 - finite("lo") / 2)
    share = F.when(width > LARGEST, halves).otherwise((finite("v") - finite("lo")) / width)
    part = (
        F.when(F.col("v") < -LARGEST, -1)
        .when(F.col("v") > LARGEST, CELLS + 1)
        .otherwise(F.when(width > 0, F.floor(share * CELLS)).otherwise(0))
    )
    cells = (
        _within(values, intervals, size, sizes)
        .groupBy("g", "lo", "below", part.alias("part"))
        .agg(F.sum("w").alias("n"), F.min("v").alias("c_lo"), F.max("v").alias("c_hi"))
    )
    return _pick(cells, intervals)


def _order_statistics(
    values: DataFrame,
    intervals: DataFrame,
    sizes: DataFrame | None,
    most_ranks: int,
    rows_in_one_task: int,
) -> DataFrame:
    """(g, rank, v): the values at the wanted zero-based ranks of each group; ``values`` are (g, v, w), a
    value and how many rows have it.

    Every pass narrows the interval around a rank to one of ``CELLS`` parts, set to the least and
    greatest value found there, until few enough rows are left to list their distinct values.
    """
    while True:
        size = intervals.agg(
            F.count("*").alias("n"),
            F.lit(most_ranks).alias("ranks"),
            F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside"))).alias("most"),
        ).first()
        if size["most"] is None or size["most"] <= rows_in_one_task:
            break
        intervals = checkpointed(_narrowed(values, intervals, size, sizes))
    done = intervals.where(F.col("lo") == F.col("hi")).select(
        "g", F.explode("ranks").alias("rank"), F.col("lo").alias("v")
    )
    if size["most"] is None:
        return done
    left = intervals.where(F.col("lo") < F.col("hi"))
    distinct = (
        _within(values, left, size, sizes)
        .groupBy("g", "lo", "below", "v")
        .agg(F.sum("w").alias("n"))
        .select("g", "lo", "below", "n", F.col("v").alias("c_lo"), F.col("v").alias("c_hi"))
    )
    found = _pick(distinct, left).select(
        "g", F.explode("ranks").alias("rank"), F.col("lo").alias("v")
    )
    return done.unionByName(found)


def _ranks(p: float) -> tuple[Column, Column]:
    """Zero-based ranks next to quantile ``p`` of ``n`` values."""
    h = F.lit(float(p)) * (F.col("n") - 1)
    return F.floor(h), F.ceil(h)


def _interpolated(p: float) -> Column:
    lower, upper = _ranks(p)
    at, after = F.col("at_rank")[lower], F.col("at_rank")[upper]
    between = at + (after - at) * (F.lit(float(p)) * (F.col("n") - 1) - lower)
    return F.when(at == after, at).otherwise(between)


def _sampled(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(g, n, mean, std, min, max, sample): one read; a sample is a sorted array of SAMPLE values at most.

    Rows fall into SAMPLE parts at random and each part keeps a random one, so samples are combined
    before the shuffle. Chance changes the brackets, never a result.
    """
    v = F.col("v")
    rows = df.select(key, seen_value(value).alias("v")).select(
        "g", "v", F.floor(F.rand(1) * SAMPLE).alias("part"), F.when(v.isNotNull(), F.rand(2)).alias("order")
    )
    parts = rows.groupBy("g", "part").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("square"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.min_by(v, "order").alias("some"),
    )
    part = F.when(F.col("n") > 0, F.struct("n", "mean", "square"))
    groups = parts.groupBy("g").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
        F.sort_array(F.collect_list("some")).alias("sample"),
        F.collect_list(part).alias("parts"),
    )

    def total(of) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + of(p))

    groups = groups.withColumn("mean", F.try_divide(total(lambda p: p["n"] * p["mean"]), F.col("n")))
    around = total(lambda p: p["square"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    std = F.when(F.col("n") > 1, F.sqrt(around / (F.col("n") - 1)))
    return groups.select("g", "n", "mean", std.alias("std"), "min", "max", "sample")


def _bracket(rank: Column) -> Column:
    """The sample's values so far around a rank that the rank lies between them."""
    n, size = F.col("n"), F.size("sample")
    p = (rank + 0.5) / n
    reach = F.sqrt(p * (1 - p) * size) * DEVIATIONS + 1
    low, high = F.floor(p * size - reach).cast("int"), F.ceil(p * size + reach).cast("int")
    return F.struct(
        F.when(low < 0, F.col("min")).otherwise(F.get("sample", F.greatest(low, F.lit(0)))).alias("lo"),
        F.when(high >= size, F.col("max")).otherwise(F.get("sample", F.least(high, size - 1))).alias("hi"),
    )


def _disjoint(brackets: Column) -> Column:
    """Brackets in order, those that meet as one."""
    kind = "array<struct<lo:double,hi:double>>"

    def add(done: Column, one: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], one["hi"]).alias("hi"))
        meets = (F.size(done) > 0) & (one["lo"] <= F.try_element_at(done, F.lit(-1))["hi"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(one))
        )

    def first(done: Column, one: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(one)).otherwise(add(done, one))

    return F.aggregate(F.sort_array(brackets), F.array().cast(kind), first)


def _cells(values: DataFrame, brackets: DataFrame, most: int, groups: int, sizes: DataFrame | None) -> DataFrame:
    """The second read: (g, region, v, n, lo, hi). Odd regions are brackets, even ones lie between."""
    if sizes is None:
        row = brackets.first()
        spans = [(F.lit(b["lo"]), F.lit(b["hi"])) for b in row["brackets"]] if row else []
        joined = values
    else:
        side = brackets.select(F.col("g").alias("ig"), "brackets")
        joined = join_by_group(values, side, groups, sizes)
        one = [F.get("brackets", F.lit(k)) for k in range(most)]
        spans = [(b["lo"], b["hi"]) for b in one]
    v, region = F.col("v"), F.lit(0)
    for lo, hi in spans:
        above = F.when(v > hi, 2).when(v >= lo, 1).otherwise(0)
        region = region + F.coalesce(above, F.lit(0))
    rows = joined.select("g", "v", region.alias("region"))
    single = F.when(F.col("region") % 2 == 1, v)
    return rows.groupBy("g", "region", single.alias("one")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).select("g", "region", F.col("one").alias("v"), "n", "lo", "hi")


def quantiles_by(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = 10_000,
    rows_in_one_task: int = ROWS_IN_ONE_TASK,
    reach: float | None = None,
) -> Quantiles:
    """Columns ``by``, n, mean, std, min and max, and one column for each quantile.

    Quantiles are linear between neighbouring values; nulls and NaN are left out. ``approx``
    keeps one bounded sketch for each group. Exact quantiles come from two reads of ``df``; what the second
    read keeps around a rank is narrowed down until at most ``rows_in_one_task`` rows are left, whose
    distinct values are listed, so that a group with a third of all rows is as good as any other. With
    ``reach`` the values around the fences, so many ranges of the outer quantiles beyond them, are
    kept too.
    """
    by = list(by)
    v = seen_value(value)
    key = (_key(by) if by else F.lit(0)).alias("g")
    if approx:
        sketches = [F.percentile_approx(v, p, accuracy).alias(a) for p, a in zip(probs, names)]
        moments = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
        moments += [F.min(v).alias("min"), F.max(v).alias("max")]
        table = checkpointed(df.groupBy(*by).agg(*moments, *sketches))
        return Quantiles(table, table.count(), table.select(key, "n"))

    bounds = checkpointed(_sampled(df, key, value))
    groups = bounds.count()
    sizes = bounds.select("g", "n")
    leading = ["g.*"] if by else []
    wanted = bounds.where(F.col("n") > 0)
    ranks = [r for p in probs for r in _ranks(p)]
    brackets = [_bracket(r) for r in ranks]
    if reach is not None:
        first, last = brackets[0], brackets[-1]
        # Fences move with the outer quantiles: so far as these can lie, so far can the fences.
        widest, least = last["hi"] - first["lo"], F.greatest(last["lo"] - first["hi"], F.lit(0.0))
        fences = [
            (first["lo"] - widest * reach, first["hi"] - least * reach),
            (last["lo"] + least * reach, last["hi"] + widest * reach),
        ]
        brackets += [F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in fences]
    kept = checkpointed(wanted.select("g", _disjoint(F.array(*brackets)).alias("brackets")))
    by_group = sizes if by else None
    values = df.select(key, v.alias("v")).where(F.col("v").isNotNull())
    cells = checkpointed(_cells(values, kept, len(brackets), groups, by_group))

    regions = cells.groupBy("g", "region").agg(F.sum("n").alias("n"), F.min("lo").alias("c_lo"), F.max("hi").alias("c_hi"))
    whole = wanted.select("g", F.lit(0).alias("lo"), F.lit(0).cast("bigint").alias("below"), F.array_distinct(F.array(*ranks)).alias("ranks"))
    placed = regions.join(whole.select("g", "lo", "below"), "g")
    held = checkpointed(_pick(placed, whole, also=["region"]))
    proven = (F.col("region") % 2 == 1) | (F.col("lo") == F.col("hi"))
    listed = cells.where(F.col("v").isNotNull()).select("g", "v", F.col("n").alias("w"))
    most = len(ranks)
    found = _order_statistics(listed, held.where(proven).drop("region"), by_group, most, rows_in_one_task)
    missed = held.where(~proven).drop("region")
    if missed.take(1):
        single = values.withColumn("w", F.lit(1).cast("bigint"))
        found = found.unionByName(_order_statistics(single, missed, by_group, most, rows_in_one_task))
    found = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at_rank"))
    table = bounds.drop("sample").join(found, "g", "left").select(
        *leading, *MOMENTS, *[_interpolated(p).alias(a) for p, a in zip(probs, names)]
    )
    return Quantiles(table, groups, sizes, cells)
