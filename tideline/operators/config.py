"""Thresholds of the rules and detectors; pass a changed copy to any operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: The classes in code order.
CLASSES = ("VEG_DUNES", "DRY_BEACH", "BEACH_WET", "WATER", "WAVE_CRESTS", "UNKNOWN")
#: Names that manual labels use for the same classes.
CLASS_ALIAS = {
    "VEGETATED_DUNES": "VEG_DUNES",
    "VEGETATED_DUNE": "VEG_DUNES",
    "BEACH_DRY": "DRY_BEACH",
    "BEACH_WET": "BEACH_WET",
    "WATER": "WATER",
}


@dataclass(frozen=True)
class Config:
    # classes
    nir_ratio_water_max: float = 0.35
    nir_ratio_water_sure: float = 0.30
    nir_ratio_wet_min: float = 0.40
    nir_ratio_wet_max: float = 0.70
    nir_ratio_dry_min: float = 0.80
    ndwi_water_min: float = 0.60
    ndwi_wet_min: float = 0.25
    blue_red_water_min: float = 0.95
    wet_brightness_max: float = 195.0
    dry_brightness_min: float = 195.0
    dry_variability_max: float = 10.0
    veg_variability_min: float = 15.0
    veg_brightness_max: float = 190.0
    # peaks
    oscillation_prominence: float = 5.0
    foam_prominence: float = 10.0
    foam_width: float = 2.0
    # dry/wet boundary
    derivative: float = -8.0
    nir_min: float = 50.0
    strict_low: float = 0.60
    strict_variance_min: float = 1.0
    strict_drop: float = 50.0
    soft_drop: float = 39.0
    soft_brightness: float = 175.0
    soft_nir: float = 135.0
    soft_variance: float = 1.5
    relaxed_drop: float = 20.0
    relaxed_brightness: float = 160.0
    relaxed_nir: float = 100.0
    relaxed_variance: float = 1.2
    relaxed_low: float = 0.40
    fallback_low: float = 0.50
    zone: tuple = (40.0, 120.0)
    bounds: tuple = (30.0, 250.0)
    # filtering
    merge_distance: float = 5.0
    edge_buffer: float = 10.0
    min_confidence: float = 0.75
    # monotonic smoothing
    min_span: float = 2.5

    def but(self, **changes) -> "Config":
        return replace(self, **changes)


DEFAULT = Config()

#: The four threshold sets that are compared with each other.
THRESHOLD_SETS = {
    "strict": dict(soft_drop=40.0, soft_brightness=190.0, soft_nir=160.0),
    "moderate": dict(soft_drop=35.0, soft_brightness=180.0, soft_nir=145.0),
    "relaxed": dict(soft_drop=39.0, soft_brightness=183.0, soft_nir=139.0),
    "empirical": dict(soft_drop=43.0, soft_brightness=172.0, soft_nir=147.0),
}
