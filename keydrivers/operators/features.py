"""Categories to index to one-hot to feature vector, and the names of its slots."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import VECTOR_INFIX, VECTOR_SUFFIX
from ..spec import FeatureSpec

FEATURES = "features"
INDEX_SUFFIX = "_idx"

# A slot needs a name, so the empty text gets this one; a category of that name gets more brackets.
EMPTY_CATEGORY = "(empty)"
_BRACKETED = r"^\(+empty\)+$"


@dataclass(frozen=True)
class Slot:
    """One position of the feature vector."""

    idx: int
    name: str
    field: str
    category: str | None


def require_values(df: DataFrame, cols: Iterable[str], invalid: str = "error") -> DataFrame:
    """Make the handling of missing numbers explicit, in the same pass as their use.

    ``error`` stops the job and names the column, ``skip`` drops the rows, ``keep`` passes them on
    as NaN. A missing category is never invalid: it gets no slot of its own.
    """
    cols = list(cols)
    if invalid == "keep":
        return df
    if invalid == "skip":
        return df.dropna(subset=cols)
    if invalid != "error":
        raise ValueError(f"invalid must be 'error', 'skip' or 'keep', not {invalid!r}")

    def checked(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(
            v.isNull() | F.isnan(v), F.raise_error(F.lit(f"no number in column '{c}'"))
        ).otherwise(v)

    return df.withColumns({c: checked(c) for c in cols})


def named_categories(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Category columns as text, with a name for the empty text."""

    def named(c: str) -> Column:
        text = F.col(c).cast("string")
        bracketed = F.concat(F.lit("("), text, F.lit(")"))
        return (
            F.when(text == "", EMPTY_CATEGORY)
            .when(text.rlike(_BRACKETED), bracketed)
            .otherwise(text)
        )

    return df.withColumns({c: named(c) for c in cols})


def index_categories(spec: FeatureSpec) -> StringIndexer:
    """Index by falling frequency, ties by name; missing and unseen share one more index."""
    return StringIndexer(
        inputCols=list(spec.categorical),
        outputCols=[c + INDEX_SUFFIX for c in spec.categorical],
        handleInvalid="keep",
    )


def one_hot(spec: FeatureSpec) -> OneHotEncoder:
    """A slot for every seen category; the index for missing and unseen has no slot."""
    return OneHotEncoder(
        inputCols=[c + INDEX_SUFFIX for c in spec.categorical],
        outputCols=[c + VECTOR_SUFFIX for c in spec.categorical],
    )


def build_features(spec: FeatureSpec, invalid: str = "error") -> VectorAssembler:
    """One vector: the one-hot parts, then the numeric predictors."""
    return VectorAssembler(
        inputCols=[c + VECTOR_SUFFIX for c in spec.categorical] + list(spec.numeric),
        outputCol=FEATURES,
        handleInvalid=invalid,
    )


def feature_pipeline(spec: FeatureSpec, invalid: str = "error") -> Pipeline:
    """All feature stages. One stage handles all categories, so they are counted in one job."""
    encoders = [index_categories(spec), one_hot(spec)] if spec.categorical else []
    return Pipeline(stages=[*encoders, build_features(spec, invalid)])


def prepared(df: DataFrame, spec: FeatureSpec, invalid: str = "error") -> DataFrame:
    """Training rows as the feature stages expect them."""
    spec.validate(df)
    return require_values(named_categories(df, spec.categorical), spec.measures, invalid)


def feature_slots(
    with_features: DataFrame | T.StructType, spec: FeatureSpec, features: str = FEATURES
) -> list[Slot]:
    """Slots in order, from the column metadata; no job is started.

    The source column is found among the columns of the spec, so a column may well have
    ``_vec_`` in its own name.
    """
    schema = with_features if isinstance(with_features, T.StructType) else with_features.schema
    groups = schema[features].metadata["ml_attr"]["attrs"]
    attributes = sorted((a for group in groups.values() for a in group), key=lambda a: a["idx"])
    slots = []
    for a in attributes:
        name = a["name"]
        if name in spec.numeric:
            slots.append(Slot(a["idx"], name, name, None))
            continue
        owners = [c for c in spec.categorical if name.startswith(c + VECTOR_INFIX)]
        field = max(owners, key=len)
        slots.append(Slot(a["idx"], name, field, name[len(field + VECTOR_INFIX) :]))
    return slots
