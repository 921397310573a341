"""Thresholds, presets and rule table of the spatial relations.

Fixed values: they have to equal the published configuration for equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DIRECTIONS = ("left_of", "right_of", "above", "below")
EXTREMES = ("leftmost", "rightmost", "topmost", "bottommost")
SIZES = ("largest", "smallest")


@dataclass(frozen=True)
class Rule:
    """Which flags make a component ineligible for a relation."""

    relation: str
    border: bool = False
    anchor_border: bool = False
    merge: bool = False
    tiny: bool = False
    min_components: int = 1


RULES = (
    *(Rule(r) for r in (*DIRECTIONS, *EXTREMES)),
    Rule("nearest", True, True, True, True, 2),
    Rule("largest", True, False, True, False, 2),
    Rule("smallest", True, False, True, True, 2),
)


@dataclass(frozen=True)
class Config:
    width: int = 512
    height: int = 512
    merge_extent: float = 0.20
    tiny_area: int = 150
    extreme_margin: float = 4.0
    nearest_px: float = 2.0
    nearest_share: float = 0.005
    size_ratio: float = 1.10
    preset: str = "medium"
    presets: dict[str, tuple[float, float]] = field(default_factory=lambda: {"strict": (2.0, 0.06), "medium": (1.2, 0.04), "loose": (1.0, 0.02)})
    quotas: dict[int, int] = field(default_factory=lambda: {1: 6, 2: 4, 3: 2})
    seed: int = 20260804

    def __post_init__(self):
        if self.preset not in self.presets:
            raise ValueError(f"unknown preset {self.preset}")

    @property
    def diagonal(self) -> float:
        return (self.width**2 + self.height**2) ** 0.5

    @property
    def alpha(self) -> float:
        return self.presets[self.preset][0]

    @property
    def tau(self) -> float:
        return self.presets[self.preset][1]


DEFAULT = Config()
PROGRAMS = (
    *EXTREMES,
    *SIZES,
    *(f"{s}_to_nearest" for s in SIZES),
    *(f"{s}_to_{d}" for s in SIZES for d in DIRECTIONS),
    *(f"largest_to_{d}_to_nearest" for d in DIRECTIONS),
)
