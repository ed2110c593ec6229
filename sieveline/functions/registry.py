"""Extension points: feature families, calibrators, threshold objectives and tie rules, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from sieveline.operators.calibration import CALIBRATORS, fit_calibrator
from sieveline.operators.images import FAMILIES, FEATURE_SETS
from sieveline.operators.thresholds import OBJECTIVES, TIE_BREAKS


def register_family(name: str, job: Callable[[DataFrame, int, int], DataFrame], sets: tuple[str, ...] = ()) -> None:
    """Add a feature family, as a set of its own and to the named sets."""
    if name in FAMILIES:
        raise ValueError(f"feature family {name} exists")
    FAMILIES[name] = job
    FEATURE_SETS[name] = [name]
    for other in sets:
        FEATURE_SETS[other].append(name)


def register_objective(name: str, expression: Callable[..., Column]) -> None:
    """Add a threshold objective over tn, fp, fn, tp."""
    if name in OBJECTIVES:
        raise ValueError(f"objective {name} exists")
    OBJECTIVES[name] = expression


def names() -> dict[str, list[str]]:
    return {
        "feature_set": sorted(FEATURE_SETS),
        "calibrator": sorted(CALIBRATORS),
        "objective": sorted(OBJECTIVES),
        "tie_break": sorted(TIE_BREAKS),
    }


__all__ = ["fit_calibrator", "names", "register_family", "register_objective"]
