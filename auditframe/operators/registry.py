"""The catalogue of checks. A check takes an ``AuditFrame`` and returns evidence, or None where it doesn't apply."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.frame import AuditFrame


@dataclass(frozen=True)
class Check:
    id: str
    key: str
    unit: str
    severity: str
    run: Callable[[AuditFrame], DataFrame | None]


CHECKS: dict[str, Check] = {}


def check(id: str, key: str, unit: str, severity: str = "warning"):
    def add(run: Callable[[AuditFrame], DataFrame | None]):
        CHECKS[key] = Check(id, key, unit, severity, run)
        return run

    return add
