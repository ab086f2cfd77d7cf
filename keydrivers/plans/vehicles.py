"""Emission drivers of vehicles: the analysis on yearly fuel-consumption ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import operators as ops
from ..sources import read_table
from ..spec import FeatureSpec
from .analysis import DriverAnalysis, analyse_drivers

# File headings and their standard names.
VEHICLE_COLUMNS = {
    "ModelYear": "model_year",
    "Make": "make",
    "Model": "model",
    "VehicleClass": "vehicle_class",
    "EngineSize_L": "engine_size_l",
    "Cylinders": "cylinders",
    "Transmission": "transmission",
    "FuelType": "fuel_type",
    "FuelConsCity_L100km": "fuel_cons_city_L100km",
    "FuelConsHwy_L100km": "fuel_cons_hwy_L100km",
    "Comb_L100km": "fuel_cons_comb_L100km",
    "Comb_mpg": "fuel_cons_comb_MPG",
    "CO2Emission_g_km": "CO2_emission_gkm",
    "CO2Rating": "CO2_rating",
    "SmogRating": "smog_rating",
}

# The roles of the standard columns.
VEHICLE_SPEC = FeatureSpec(
    numeric=(
        "engine_size_l",
        "cylinders",
        "model_year",
        "fuel_cons_city_L100km",
        "fuel_cons_hwy_L100km",
        "fuel_cons_comb_L100km",
        "fuel_cons_comb_MPG",
    ),
    categorical=("vehicle_class", "make", "transmission", "fuel_type"),
    target="CO2_emission_gkm",
)
STRONG_SPEC = FeatureSpec(
    numeric=("fuel_cons_comb_L100km",),
    categorical=("fuel_type",),
    target="CO2_emission_gkm",
)
CATEGORIES = ("make", "model", "vehicle_class", "transmission", "fuel_type")

_TEXT = {"Make", "Model", "VehicleClass", "Transmission", "FuelType"}
_WHOLE = {"ModelYear", "Cylinders", "Comb_mpg", "CO2Emission_g_km", "CO2Rating", "SmogRating"}

VEHICLE_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.StringType()
            if name in _TEXT
            else T.IntegerType()
            if name in _WHOLE
            else T.DoubleType(),
        )
        for name in VEHICLE_COLUMNS
    ]
)


def load_vehicles(
    spark: SparkSession, path: str, fmt: str = "csv", infer: bool = False
) -> DataFrame:
    """Vehicles with standard names and clean classes."""
    schema = None if infer else VEHICLE_SCHEMA
    raw = read_table(spark, path, schema, fmt)
    return ops.normalize_category(
        ops.standardize_columns(raw, VEHICLE_COLUMNS), ["vehicle_class"]
    )


def analyse_vehicles(vehicles: DataFrame, **options) -> DriverAnalysis:
    """Drop the mostly empty rating columns, then analyse what drives emissions."""
    rows = ops.drop_sparse_columns(vehicles, keep=VEHICLE_SPEC.columns)
    return analyse_drivers(rows, VEHICLE_SPEC, STRONG_SPEC, profiled=CATEGORIES, **options)
