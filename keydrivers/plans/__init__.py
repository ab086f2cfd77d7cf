from .analysis import DriverAnalysis, analyse_drivers, write_results
from .vehicles import (
    STRONG_SPEC,
    VEHICLE_COLUMNS,
    VEHICLE_SCHEMA,
    VEHICLE_SPEC,
    analyse_vehicles,
    load_vehicles,
)

__all__ = [
    "STRONG_SPEC",
    "VEHICLE_COLUMNS",
    "VEHICLE_SCHEMA",
    "VEHICLE_SPEC",
    "DriverAnalysis",
    "analyse_drivers",
    "analyse_vehicles",
    "load_vehicles",
    "write_results",
]
