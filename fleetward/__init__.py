"""Security analytics over fleets of web applications, on Spark DataFrames."""

from __future__ import annotations

from .catalog.lists import RULES
from .functions.identity import dedupe_key, finding_id
from .operators.grading import grade
from .operators.pipeline import suppress
from .operators.report import Reports
from .functions.secrets import classify_secret
from .functions.paths import target_type as detect_target_type
from .plans.fleet import Fleet, FleetResult, reports, scan_fleet, summary

__all__ = [
    "Fleet", "FleetResult", "classify_secret", "dedupe_key", "detect_target_type", "finding_id", "grade", "reports",
    "rules", "run_scan", "scan", "summary", "suppress",
]


def run_scan(fleet: Fleet, skip_engines: bool = False) -> FleetResult:
    """Findings, passes and grades of every target of the fleet."""
    return scan_fleet(fleet, skip_engines)


def scan(fleet: Fleet, started_at: str, finished_at: str, skip_engines: bool = False) -> Reports:
    """One summary row per target, and all findings in report order."""
    return reports(fleet, scan_fleet(fleet, skip_engines), started_at, finished_at)


def rules() -> tuple[tuple[str, str, str], ...]:
    """(id, category, mode) of every rule in registry order."""
    return RULES
