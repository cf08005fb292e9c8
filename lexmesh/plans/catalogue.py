"""All registered queries, gathered from the family modules."""

from __future__ import annotations

from importlib import import_module

from lexmesh.plans import register

FAMILIES = ["text_plans", "rank_plans", "graph_plans", "concept_plans", "extract_plans", "catalog_plans",
            "evaluation_plans", "change_plans", "retrieval_plans", "mention_plans"]


def _load() -> None:
    for family in FAMILIES:
        import_module(f"lexmesh.plans.{family}")


def plans() -> dict[str, register.Plan]:
    _load()
    return dict(register.PLANS)


def oracles() -> dict[str, str]:
    _load()
    return dict(register.ORACLES)
