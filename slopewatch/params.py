"""Model parameters: the fixed values of the scoring model and its services.

Scalars become literals in the plan; the per-macroregion blocks become a
four-row lookup. ``load`` reads overrides from YAML, ``check`` refuses a set
that is not consistent.
"""

from __future__ import annotations

import copy
from typing import Any

# --- fixed values ---------------------------------------------------------
LEVELS = ("None", "Low", "Moderate", "High", "VeryHigh")

PARAMS: dict[str, Any] = {
    "component_weights": {"s": 0.35, "m": 0.40, "e": 0.15, "f": 0.07, "h": 0.03},
    "static": {
        "weights": {
            "susceptibility": 0.0,
            "density": 0.375,
            "slope": 0.30,
            "hazard": 0.225,
            "lithology": 0.10,
        },
        "slope_saturation": 45.0,
        "density_saturation": 8.0,
    },
    "meteo_weights": {"caine": 0.45, "api": 0.30, "soil": 0.25},
    "rain_event": {"dry_samples": 6, "min_mm": 2.0, "excess_cap": 1.0},
    "rain_threshold": {
        "italy_default": {"alpha": 7.190, "beta": 0.568},
        "southern_italy": {"alpha": 8.750, "beta": 0.645},
        "central_italy": {"alpha": 7.950, "beta": 0.608},
        "northern_italy": {"alpha": 6.370, "beta": 0.512},
    },
    "rain_floor": {
        "wetness_min": 0.5,
        "italy_default": {"alpha": 4.30, "beta": 0.568},
        "southern_italy": {"alpha": 5.25, "beta": 0.645},
        "central_italy": {"alpha": 4.75, "beta": 0.608},
        "northern_italy": {"alpha": 3.80, "beta": 0.512},
    },
    "api": {"horizon_days": 30, "decay": 0.95, "sigma_mm": 60.0, "baseline_mm": 80.0},
    "soil": {"center": 0.30, "steepness": 12.0},
    "flood": {
        "uplift": 0.5,
        "ratio_center": 2.0,
        "ratio_steepness": 0.8,
        "italy_default": {"center": 90.0, "steepness": 35.0},
        "southern_italy": {"center": 80.0, "steepness": 30.0},
        "central_italy": {"center": 95.0, "steepness": 35.0},
        "northern_italy": {"center": 110.0, "steepness": 40.0},
    },
    "snow": {"min_depth_m": 0.05, "rain_scale_mm": 30.0, "weight": 0.15},
    "seismic": {
        "tau_days": 2.0,
        "min_magnitude": 3.5,
        "lookback_days": 7.0,
        "threshold_g": 0.05,
        "scale_g": 0.05,
    },
    "fire": {"peak_months": 6.0, "denominator": 50.0, "max_months": 24.0},
    "kinematic": {
        "velocity_center": 5.0,
        "velocity_sigma": 3.0,
        "acceleration_alarm": 2.0,
        "inverse_velocity_alarm": 0.10,
        "escalated_floor": 0.8,
        "weight": 0.20,
    },
    "class_bounds": [0.15, 0.35, 0.55, 0.75],
    "exposure": {
        "urban_here": 1.0,
        "urban_near": 0.5,
        "road_strong_m": 250.0,
        "road_strong": 0.6,
        "road_medium_m": 1000.0,
        "road_medium": 0.3,
        "rail_strong_m": 250.0,
        "rail_strong": 0.5,
        "rail_medium_m": 1000.0,
        "rail_medium": 0.25,
        "infra_here": 0.6,
        "infra_near": 0.3,
        "cap": 2.0,
    },
    "alert_colour": {
        "None": "verde",
        "Low": "verde",
        "Moderate": "gialla",
        "High": "arancione",
        "VeryHigh": "rossa",
    },
    "target_share": {
        "None": 0.700,
        "Low": 0.200,
        "Moderate": 0.070,
        "High": 0.025,
        "VeryHigh": 0.005,
    },
    "hazard_norm": {
        "operational": {"AA": 0.20, "P1": 0.40, "P2": 0.60, "P3": 0.80, "P4": 1.00},
        "export": {"AA": 0.10, "P1": 0.25, "P2": 0.50, "P3": 0.75, "P4": 1.00},
    },
    "flood_severity": {"elevata": "P3", "media": "P2", "bassa": "P1"},
    "lithology_weight": {
        "argille": 0.85,
        "flysch": 0.80,
        "complesso caotico": 0.85,
        "scisti": 0.75,
        "sabbie": 0.65,
        "limi": 0.65,
        "tufi": 0.60,
        "marne": 0.70,
        "alluvioni": 0.55,
        "conglomerati": 0.50,
        "calcari": 0.30,
        "dolomie": 0.30,
        "graniti": 0.20,
        "gneiss": 0.25,
        "vulcaniti": 0.40,
    },
    "lithology_default": 0.5,
    "sensor": {
        "unit": {
            "rainfall": "mm",
            "pore_pressure": "kPa",
            "soil_moisture": "m3/m3",
            "displacement": "mm",
            "velocity": "mm/d",
            "acceleration": "mm/d2",
        },
        "range": {
            "rainfall": [0.0, 200.0],
            "pore_pressure": [0.0, 1000.0],
            "soil_moisture": [0.0, 1.0],
            "displacement": [-50000.0, 50000.0],
            "velocity": [-2000.0, 2000.0],
            "acceleration": [-2000.0, 2000.0],
        },
        "sigma": {
            "rainfall": 0.5,
            "pore_pressure": 5.0,
            "soil_moisture": 0.02,
            "displacement": 1.0,
            "velocity": 3.0,
            "acceleration": 0.5,
        },
        "spike_factor": 5.0,
        "flatline_samples": 12,
        "gap_minutes": 60,
    },
    "alert": {
        "min_level": "Moderate",
        "min_static": 0.5,
        "dedup_minutes": 180,
        "top_k": 5,
        "forecast_dedup_hours": 24,
        "forecast_level": "High",
    },
    "nowcast": {"min_mm_h": 30.0, "min_pixels": 3, "cooldown_minutes": 45},
    "zones": {
        "eps_deg": 0.02,
        "max_zones": 50,
        "volume_trigger": 200,
        "reference_pct": 0.5,
        "margin": 0.08,
        "keep_builds": 240,
    },
    "verify": {"radius_m": 2000.0, "horizon_h": 72, "grace_h": 24},
    "drift": {"psi": 0.25, "ks": 0.2, "prediction": 0.15, "new_events": 50},
    "promotion": {
        "average_precision": 0.55,
        "brier": 0.20,
        "hit_rate": 0.70,
        "false_alarm_rate": 0.30,
        "lead_hours": 18.0,
    },
    "retention_days": {"assessments": 14, "shadow": 30},
    "training": {"background_ratio": 5.0, "block_deg": 0.5, "folds": 5, "prune_r": 0.95, "seed": 42},
    "search_radius_m": 500.0,
    "distance_cap_m": 50_000.0,
}
# --- end of fixed values --------------------------------------------------

MACROREGIONS = ("italy_default", "southern_italy", "central_italy", "northern_italy")


class ParameterError(ValueError):
    """A parameter set that contradicts itself."""


def merged(overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """The defaults with nested overrides applied."""

    def put(into: dict[str, Any], new: dict[str, Any]) -> None:
        for key, value in new.items():
            if isinstance(value, dict) and isinstance(into.get(key), dict):
                put(into[key], value)
            else:
                into[key] = value

    out = copy.deepcopy(PARAMS)
    put(out, overrides or {})
    return check(out)


def load(path: str) -> dict[str, Any]:
    """Read overrides from a YAML file and check the merged result."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return merged(yaml.safe_load(handle) or {})


def check(p: dict[str, Any]) -> dict[str, Any]:
    """Weights sum to one, bands are ordered, the default macroregion exists."""
    for label, weights in (
        ("component_weights", p["component_weights"]),
        ("static.weights", p["static"]["weights"]),
        ("meteo_weights", p["meteo_weights"]),
        ("target_share", p["target_share"]),
    ):
        total = sum(weights.values())
        if abs(total - 1.0) > 1e-6:
            raise ParameterError(f"{label} must sum to 1, got {total}")
    for block in ("rain_threshold", "rain_floor", "flood"):
        if "italy_default" not in p[block]:
            raise ParameterError(f"{block} needs the default macroregion")
    bounds = p["class_bounds"]
    if sorted(bounds) != bounds or len(set(bounds)) != 4 or not 0 < bounds[0] or not bounds[-1] < 1:
        raise ParameterError("class bounds must be four increasing values inside (0, 1)")
    ex = p["exposure"]
    for kind in ("road", "rail"):
        if not ex[f"{kind}_strong_m"] < ex[f"{kind}_medium_m"]:
            raise ParameterError(f"{kind} distance bands must be ordered")
    for name in p["rain_floor"]:
        if name in MACROREGIONS and p["rain_floor"][name]["alpha"] > p["rain_threshold"][name]["alpha"]:
            raise ParameterError(f"rain floor of {name} lies above its threshold")
    if not 0.0 < p["api"]["decay"] < 1.0:
        raise ParameterError("api.decay must lie inside (0, 1)")
    return p
