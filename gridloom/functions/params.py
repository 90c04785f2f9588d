"""Constants of a voxel map."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def log_odds(p: float) -> float:
    """ln(p / (1 - p)) in single precision."""
    return float(np.float32(math.log(p / (1 - p))))


@dataclass(frozen=True)
class MapParams:
    """Grid and occupancy parameters; dims is the number of voxels along a region's edge."""

    resolution: float = 0.1
    dims: int = 32
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    p_hit: float = 0.9
    p_miss: float = 0.45
    threshold: float = 0.0
    low: float = -2.0
    high: float = float(np.float32(3.511))

    @property
    def hit(self) -> float:
        return log_odds(self.p_hit)

    @property
    def miss(self) -> float:
        return log_odds(self.p_miss)
