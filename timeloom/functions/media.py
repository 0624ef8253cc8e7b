"""Checks of container metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sane(width: Column, height: Column, rotation: Column, fps: Column) -> Column:
    """Sides of 1..65535, a rotation by quarters, a rate above 0 and up to 1000."""
    return width.between(1, 65535) & height.between(1, 65535) & rotation.isin(0, 90, 180, 270) & (fps > 0) & (fps <= 1000) & ~F.isnan(fps)
