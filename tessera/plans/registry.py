"""All registered queries and their oracle SQL, gathered from the plan modules."""
from __future__ import annotations

import importlib

PLAN_MODULES = ["match_plans", "rules_plans", "proposal_plans", "catalog_plans", "feedback_plans", "history_plans", "ingest_plans",
                "streaming_plans"]


def _modules():
    return [importlib.import_module(f"tessera.plans.{m}") for m in PLAN_MODULES]


def queries():
    out = {}
    for mod in _modules():
        out.update(mod.QUERIES)
    return out


def oracle_sql():
    out = {}
    for mod in _modules():
        out.update(mod.SQL)
    return out
