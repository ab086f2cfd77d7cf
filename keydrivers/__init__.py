"""Regression driver analysis on Spark: what drives a numeric target, and how strongly."""

from . import functions, operators, plans, sources
from .spec import FeatureSpec

__all__ = ["FeatureSpec", "functions", "operators", "plans", "sources"]
