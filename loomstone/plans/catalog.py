"""All core queries by name; problem and reference modules register here."""

from __future__ import annotations

from loomstone.plans import core_problems, reference_a, reference_b, reference_c, reference_d, reference_e, reference_f, reference_g

_MODULES = [core_problems, reference_a, reference_b, reference_c, reference_d, reference_e, reference_f, reference_g]


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for module in _MODULES for name, q in module.SQL.items()}
