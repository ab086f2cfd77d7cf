"""A made-up vehicle file with the real headings, dirty classes and planted slopes."""

from __future__ import annotations

import numpy as np
import pandas as pd

# Emission by litre of combined consumption, by fuel.
SLOPES = {"X": 23.0, "Z": 23.5, "D": 27.0, "E": 16.5, "N": 19.0}
DIRTY_CLASSES = {
    "Compact": "compact",
    "COMPACT ": "compact",
    " Mid-size": "mid-size",
    "MID-SIZE": "mid-size",
    "SUV: Small": "suv-small",
    "SUV - SMALL": "suv-small",
    "Pickup truck: Standard": "pickup-truck-standard",
    "--a--b--": "a-b",
    "***": "",
    None: None,
}
MAKES = ["Acme", "Bolt", "Corvid", "Dyna"]
GEARS = ["A4", "A6", "M5", "AV"]


def vehicle_rows(n: int, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    fuel = rng.choice(list(SLOPES), n, p=[0.4, 0.3, 0.1, 0.15, 0.05])
    engine = np.round(rng.uniform(1.0, 6.0, n), 1)
    cylinders = np.clip(np.round(engine * 1.5 + rng.normal(0, 1, n)), 3, 12).astype(int)
    city = np.round(4 + 2.2 * engine + rng.normal(0, 1.2, n), 1)
    highway = np.round(city * 0.7 + rng.normal(0, 0.6, n), 1)
    combined = np.round(0.55 * city + 0.45 * highway, 1)
    slope = np.array([SLOPES[f] for f in fuel])
    target = np.round(slope * combined + rng.normal(0, 2, n)).astype(int)
    rated = rng.uniform(size=n) < 0.25
    classes = np.array(list(DIRTY_CLASSES), dtype=object)
    return pd.DataFrame(
        {
            "ModelYear": rng.integers(1995, 2024, n),
            "Make": rng.choice(MAKES, n),
            "Model": [f"model {i % 97}" for i in range(n)],
            "VehicleClass": classes[rng.integers(0, len(classes), n)],
            "EngineSize_L": engine,
            "Cylinders": cylinders,
            "Transmission": rng.choice(GEARS, n),
            "FuelType": fuel,
            "FuelConsCity_L100km": city,
            "FuelConsHwy_L100km": highway,
            "Comb_L100km": combined,
            "Comb_mpg": np.round(282.48 / combined).astype(int),
            "CO2Emission_g_km": target,
            "CO2Rating": pd.array(np.where(rated, 5, None), dtype="Int64"),
            "SmogRating": pd.array(np.where(rated, 3, None), dtype="Int64"),
        }
    )
