"""All core queries and their SQL twins."""

from __future__ import annotations

from assayer.plans import evaluation, extras, pools

MODULES = (evaluation, pools, extras)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out.update(m.oracle_sql())
    return out
