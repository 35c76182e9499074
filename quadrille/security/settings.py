"""Settings of a review of events."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: Fixed values.
CAMPUS_FENCE = ((-300.0, -250.0), (350.0, -250.0), (350.0, 300.0), (-300.0, 300.0))
MAX_WINDOW = 31 * 86_400


@dataclass(frozen=True)
class Settings:
    start: int = 1_800_000_000
    end: int = 1_800_000_600
    user: str = "*"
    device: str = "*"
    request_scale: float = 10.0
    failure_scale: float = 1.0
    feature_radius: float = 0.8
    geo_radius: float = 150.0
    min_pts: int = 3
    lat0: float = 20.2961
    lon0: float = 85.8245
    geo_query: tuple[float, float] = (0.0, 0.0)
    feature_query: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self) -> None:
        fine = (
            0 <= self.start < self.end
            and self.end - self.start <= MAX_WINDOW
            and all(0 < s <= 1e9 for s in (self.request_scale, self.failure_scale))
            and 0 < self.feature_radius <= 1e7
            and 0 < self.geo_radius <= 1e5
            and 1 <= self.min_pts <= 256
            and abs(self.lat0) <= 80
            and abs(self.lon0) <= 180
            and all(math.isfinite(c) and abs(c) <= 1e7 for q in (self.geo_query, self.feature_query) for c in q)
        )
        if not fine:
            raise ValueError(f"settings out of range: {self}")

    def but(self, **changes) -> Settings:
        return replace(self, **changes)

    @property
    def minutes(self) -> float:
        return (self.end - self.start) / 60.0
