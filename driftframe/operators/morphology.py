"""Morphology of masks and fields on blocks of tiles, and reductions to watershed masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from driftframe.operators import tiles
from driftframe.operators.stencil import CROSS, Offset, full


def erode(mask: DataFrame, offsets: Sequence[Offset] = CROSS, outside: bool = False, value: str = "m") -> DataFrame:
    """True where all taps are; ``outside`` is what lies beyond the border. Time offsets stay in the same pixel."""
    return tiles.still(mask, lambda a, there: tiles.extreme(a, offsets, np.fmin, float(outside)) > 0, _reach(offsets), value, "boolean")


def dilate(mask: DataFrame, offsets: Sequence[Offset] = CROSS, value: str = "m") -> DataFrame:
    """True where any tap is."""
    return tiles.still(mask, lambda a, there: tiles.extreme(a, offsets, np.fmax, 0.0) > 0, _reach(offsets), value, "boolean")


def _reach(offsets: Sequence[Offset], times: int = 1) -> tuple[int, int]:
    """Steps and pixels that stencils one after the other look away."""
    return times * max(abs(o[0]) for o in offsets), times * max(abs(k) for o in offsets for k in o[1:])


def opening(mask: DataFrame, offsets: Sequence[Offset] = CROSS, value: str = "m") -> DataFrame:
    """Eroded, then dilated."""

    def run(a: np.ndarray, there: np.ndarray) -> np.ndarray:
        low = np.where(there, tiles.extreme(a, offsets, np.fmin, 0.0), 0.0)
        return tiles.extreme(low, offsets, np.fmax, 0.0) > 0

    return tiles.still(mask, run, _reach(offsets, 2), value, "boolean")


def grey_opening(field: DataFrame, offsets: Sequence[Offset] = CROSS, value: str = "v") -> DataFrame:
    """Least of the taps, then the greatest of those."""

    def run(a: np.ndarray, there: np.ndarray) -> np.ndarray:
        low = np.where(there, tiles.extreme(a, offsets, np.fmin, np.nan), np.nan)
        return tiles.extreme(low, offsets, np.fmax, np.nan)

    return tiles.still(field, run, _reach(offsets, 2), value, "double")


def watershed_mask(field: DataFrame, distance: int = 1, value: str = "v") -> DataFrame:
    """Background for flooding: missing or not positive, eroded ``distance`` times by the full cube, with what is
    missing put back."""

    def run(a: np.ndarray, there: np.ndarray) -> np.ndarray:
        m = np.where(np.isnan(a) | (a <= 0), 1.0, 0.0)
        for _ in range(distance):
            m = np.where(there, tiles.extreme(m, full(), np.fmin, 1.0), 1.0)
        return (m > 0) | np.isnan(a)

    return tiles.still(field, run, _reach(full(), distance), value, "boolean").withColumnRenamed(value, "m")
