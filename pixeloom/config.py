"""Segmentation settings."""

from __future__ import annotations

from dataclasses import dataclass

#: Distance metrics: spatial part Euclidean or Manhattan; the colour part is Manhattan in both.
EUCLID, MANHATTAN = "euclid", "manhattan"


class ConfigError(ValueError):
    """A setting outside its range."""


@dataclass(frozen=True)
class Config:
    """Settings of one segmentation; they become literals of the plan.

    ``top_clip``: a cluster whose window is cut off at the top measures rows from ``search_size`` instead of its own
    row. ``final_update``: cluster statistics are taken once more after the last assignment.
    """

    num_of_clusters: int = 2000
    max_iterations: int = 10
    compactness: float = 10.0
    min_size_factor: float = 0.25
    subsample_stride: int = 3
    distance_metric: str = EUCLID
    top_clip: bool = True
    final_update: bool = False

    def __post_init__(self):
        if not 1 < self.num_of_clusters <= 65534:
            raise ConfigError("num_of_clusters must be in 2..65534")
        if not 1 <= self.subsample_stride <= 255:
            raise ConfigError("subsample_stride must be in 1..255")
        if self.max_iterations < 0:
            raise ConfigError("max_iterations must not be negative")
        if not self.compactness > 0:
            raise ConfigError("compactness must be positive")
        if self.distance_metric not in (EUCLID, MANHATTAN):
            raise ConfigError(f"distance_metric must be {EUCLID} or {MANHATTAN}")
