"""Scalar and pairwise geometry of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = ("component_id", "x0", "y0", "x1", "y1", "area_px", "cx", "cy", "border", "mrg", "tiny")


def sides(components: DataFrame, prefix: str, columns: tuple[str, ...] = SIDE) -> DataFrame:
    return components.select("tile_id", *(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def axis_gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0), lo_b - hi_a, lo_a - hi_b).cast("double")


def box_gap(a: str = "a", b: str = "b") -> Column:
    """Distance between the nearest pixel centres of two boxes, 0 where they meet."""
    c = lambda p, k: F.col(f"{p}_{k}")
    dx = axis_gap(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1"))
    dy = axis_gap(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1"))
    return F.sqrt(dx * dx + dy * dy)


def boundary_gap(a: str = "a", b: str = "b") -> Column:
    """Empty pixels between two components; 0 for touching ones."""
    return F.greatest(F.lit(0.0), box_gap(a, b) - 1)


def pairs(components: DataFrame, unordered: bool = False) -> DataFrame:
    """Pairs of different components of a tile: an equi-join on the tile, no exchange beyond the tile's own."""
    a, b = sides(components, "a"), sides(components, "b")
    both = a.join(b, "tile_id")
    return both.where(F.col("a_component_id") < F.col("b_component_id") if unordered else F.col("a_component_id") != F.col("b_component_id"))
