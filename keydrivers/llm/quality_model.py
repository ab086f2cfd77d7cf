"""Quality scores from statistics of whole documents.

Random Fourier features turn a Gaussian kernel over the statistics into a linear model. Each
partition sums its part of the normal equations; the sums, whose size depends on the number of
features alone, are added up and solved. A fifth of the labels that the fit does not see serves to
turn raw scores into probabilities, by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, on_executors, picked, slices, stored
from .shingles import Words, windows

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
SYMBOLS = b"#*$%&|<>"
STATISTICS = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "symbols",
    "upper",
    "digits",
    "marks",
    "bangs",
    "distinct_words",
    "distinct_runs",
    "same_as_before",
    "top_word",
    "repeated_lines",
    "log_lines",
)


@dataclass(frozen=True)
class Settings:
    """``features`` cosines of a kernel of ``width`` (in standard deviations), ``ridge`` for each
    row, scores in ``bins`` for calibration; 1 is predicted from ``threshold`` on. The sums of the
    normal equations are made in ``tasks`` tasks, and the fit uses all labelled rows."""

    features: int = 256
    width: float = 4.0
    ridge: float = 1e-4
    bins: int = 1000
    threshold: float = 0.3
    tasks: int = 32
    seed: int = 7


def _table(chars: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(chars, np.uint8), minlength=256).astype(bool)


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_MARK, _SYMBOL = _table(b".,;:!?'\"()-"), _table(SYMBOLS)


def statistics(text: bytes, words: Words) -> list[float]:
    """The values of STATISTICS for one text; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    hashes = words.hashes(text)
    n_words = len(hashes)
    lines = text.split(b"\n")
    runs = windows(hashes, 3)
    by_word = np.unique(hashes, return_counts=True)[1]
    some = max(n_words, 1)
    return [
        np.log1p(n),
        np.log1p(n_words),
        np.log1p(n / some),
        counts[_SYMBOL].sum() / n,
        counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n,
        counts[_MARK].sum() / n,
        counts[ord("!")] / n,
        len(by_word) / some,
        len(np.unique(runs)) / len(runs) if len(runs) else 1.0,
        float((hashes[1:] == hashes[:-1]).sum()) / some,
        by_word.max() / some if n_words else 0.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
    ]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fold (crc32 of the id as text, modulo 5) and the statistics of every row."""
    on_executors(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches, "text"):
            rows = np.array([statistics(x, words) for x in as_bytes(part.column("text"))])
            ends = np.arange(0, rows.size + 1, len(STATISTICS), dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "x"])

    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    found = rows.mapInArrow(run, "doc_id bigint, x array<double>")
    return found.withColumn("fold", fold(F.col("doc_id")))


def fold(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return (F.crc32(text) % FOLDS).cast("int")


@dataclass
class Model:
    """Means and spreads of the statistics, the cosines, their weights, and the steps that turn raw
    scores into probabilities."""

    settings: Settings
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None
    frequencies: np.ndarray = field(init=False)
    phases: np.ndarray = field(init=False)

    def __post_init__(self):
        drawn = np.random.default_rng(self.settings.seed)
        shape = (len(STATISTICS), self.settings.features)
        self.frequencies = drawn.normal(0, 1 / self.settings.width, shape)
        self.phases = drawn.uniform(0, 2 * np.pi, self.settings.features)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of statistics, with a constant in the last place."""
        scaled = np.clip((x - self.mean) / self.spread, -8, 8)
        found = np.cos(scaled @ self.frequencies + self.phases)
        found *= np.sqrt(2 / self.settings.features)
        return np.hstack([found, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.steps is not None:
            raw = np.interp(raw, *self.steps)
        return np.clip(raw, 0.0, 1.0)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def _sums(train: DataFrame, model: Model) -> np.ndarray:
    """Normal equations: features times features and, in the last column, times labels."""
    size = model.settings.features + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                z = model.cosines(_rows(part.column("x")))
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ part.column("y").to_numpy()
        rows = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), rows], ["i", "v"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.vstack(rows["v"].to_list()), axis=0)
        return pd.DataFrame({"i": rows["i"].iloc[:1], "v": [total]})

    schema = "i int, v array<double>"
    # At most ``tasks`` rows come together for each row of the matrix.
    parts = train.repartition(model.settings.tasks).mapInArrow(run, schema)
    rows = parts.groupBy("i").applyInPandas(add, schema).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


def fitted(rows: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the labelled rows that are not held out. Without any, every score is one half."""
    known = labels.where("y is not null and doc_id is not null").select("doc_id", "y")
    known = rows.where(F.col("fold") != HELD_OUT).join(known, "doc_id")
    known = stored(known.select("fold", "x", F.col("y").cast("double").alias("y")), "labelled")
    values = [F.col("x")[i] for i in range(len(STATISTICS))]
    found = known.agg(*map(F.avg, values), *map(F.stddev_pop, values), F.count("*")).first()
    n, k = found[-1], len(STATISTICS)
    if not n:
        model = Model(settings, np.zeros(k), np.ones(k))
        model.weights = np.append(np.zeros(settings.features), 0.5)
        return model
    spread = np.array(found[k : 2 * k])
    model = Model(settings, np.array(found[:k]), np.where(spread > 1e-9, spread, 1.0))
    train = known.where(F.col("fold") != CALIBRATION)
    sums = _sums(train if not train.isEmpty() else known, model)
    size = settings.features + 1
    gram, moment = sums[:, :size], sums[:, size]
    penalty = np.full(size, settings.ridge * max(gram[-1, -1], 1.0))
    penalty[-1] = 0.0
    model.weights = np.linalg.lstsq(gram + np.diag(penalty), moment, rcond=None)[0]
    model.steps = _calibrated(known.where(F.col("fold") == CALIBRATION), model)
    return model


def _calibrated(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray] | None:
    """Steps of an isotonic regression on raw scores, added up in bins of equal width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_rows(batch.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], ["raw", "y"])

    bins = model.settings.bins
    place = F.round(F.greatest(F.least("raw", F.lit(1.5)), F.lit(-0.5)) * bins)
    points = (
        rows.select("x", "y")
        .mapInArrow(run, "raw double, y double")
        .groupBy((place / bins).alias("at"))
        .agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    )
    # Two numbers and a weight for each bin, whatever the number of rows.
    points = points.sparkSession.createDataFrame(points.toPandas(), "at double, label double, weight double")
    if points.isEmpty():
        return None
    points = points.withColumn("features", array_to_vector(F.array("at")))
    fit = IsotonicRegression(weightCol="weight").fit(points)
    return np.array(fit.boundaries.toArray()), np.array(fit.predictions.toArray())


def scored(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    Nothing but the text enters a score. A null text counts as empty. Rows without an id are scored
    and have no label; repeated labels count as often as they come. Other columns are not carried; no
    rows give no rows. The statistics are written once, and everything else reads them.
    """
    rows = stored(described(docs, id_col, text_col), "statistics")
    known = picked(labels, doc_id=id_col, y=label_col)
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, known, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.scores(_rows(batch.column("x")))
            arrays = [batch.column("doc_id"), batch.column("fold"), pa.array(found)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fold", "score"])

    found = rows.select("doc_id", "fold", "x").mapInArrow(run, "doc_id bigint, fold int, score double")
    return found.select(
        "doc_id",
        (F.col("fold") == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
