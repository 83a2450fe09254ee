"""The rule registry: every native rule under one interface, and rules that others add."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..catalog import lists
from ..catalog.texts import VARIANTS, Variant

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rule:
    """``run(tables)`` returns compact findings; ``ord`` decides ties between rules.

    ``variants`` holds category, confidence and texts of the findings that the catalogue does not know.
    """

    id: str
    category: str
    mode: str
    ord: int
    run: Callable[[dict[str, DataFrame]], DataFrame]
    variants: Mapping[str, Variant] = field(default_factory=dict)

    def applies_to(self, target_type: str) -> bool:
        wanted = "blackbox" if target_type == "url" else "whitebox"
        return self.mode in ("both", wanted)


RULE_META = {rid: (category, mode, i) for i, (rid, category, mode) in enumerate(lists.RULES, start=1)}


def known_variants(rules: Iterable) -> dict[str, Variant]:
    """The catalogue and what added rules bring along; a name may not be given twice."""
    out = dict(VARIANTS)
    for rule in rules:
        for name, variant in rule.variants.items():
            if out.get(name, variant) != variant:
                raise ValueError(f"variant {name!r} of rule {getattr(rule, 'id', None) or rule.key!r} exists already")
            if not (variant.category and variant.confidence and variant.title and variant.why):
                raise ValueError(f"variant {name!r} lacks a category, a confidence or a text")
            out[name] = variant
    return out


def run_isolated(rules: Iterable[Rule], tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Plans of all rules that can be built; a rule that raises yields nothing.

    Isolation is per plan: rule expressions only use functions that return NULL on
    bad data, so one rule's data cannot fail the job of the others.
    """
    plans = []
    for rule in rules:
        try:
            plans.append(rule.run(tables))
        except Exception as error:  # noqa: BLE001 - a broken rule must not stop the others
            log.warning("rule %s skipped: %s", rule.id, error)
    return plans


def union_all(plans: Sequence[DataFrame]) -> DataFrame:
    out = plans[0]
    for plan in plans[1:]:
        out = out.unionByName(plan)
    return out
