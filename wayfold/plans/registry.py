"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

import importlib

from wayfold.operators import packed
from wayfold.plans.base import QUERIES, SQL

for _m in ("reachability", "network_tables", "vectors", "designs", "reports", "extras", "growing"):
    importlib.import_module(f"wayfold.plans.{_m}")


def flagship(spark, sf_dir):
    """Accessibility of every origin under a design."""
    return QUERIES["access_by_origin"](spark, sf_dir)


def queries() -> dict:
    return QUERIES | {"p5_found": packed.p5_found}


def oracle_sql() -> dict[str, str]:
    return SQL | {"p5_found": packed.P5_SQL}
