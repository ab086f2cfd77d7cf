"""Column roles: which columns explain, and which column is explained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric predictors, categorical predictors and the target of one analysis."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    target: str = "target"

    def __post_init__(self) -> None:
        object.__setattr__(self, "numeric", tuple(self.numeric))
        object.__setattr__(self, "categorical", tuple(self.categorical))
        names = [*self.numeric, *self.categorical, self.target]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"columns with more than one role: {twice}")
        if not self.numeric and not self.categorical:
            raise ValueError("a FeatureSpec needs at least one predictor")

    @property
    def predictors(self) -> tuple[str, ...]:
        """Categorical predictors first, as they are laid out in the feature vector."""
        return self.categorical + self.numeric

    @property
    def measures(self) -> tuple[str, ...]:
        """Numeric predictors and the target: the columns of a correlation matrix."""
        return (*self.numeric, self.target)

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.predictors, self.target)

    def validate(self, df: DataFrame) -> "FeatureSpec":
        """Check names and types against ``df.schema``; no job is started."""
        types = {f.name: f.dataType for f in df.schema.fields}
        missing = [c for c in self.columns if c not in types]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        not_numeric = [c for c in self.measures if not isinstance(types[c], T.NumericType)]
        if not_numeric:
            raise TypeError(f"numeric predictors and target must be numeric: {not_numeric}")
        return self
