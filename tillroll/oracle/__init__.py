"""An independent SQL statement per query, for comparison in another engine."""

from __future__ import annotations

from tillroll.oracle import (
    checks_sql,
    dashboard_sql,
    marts_sql,
    measures_sql,
    preparation_sql,
    sales_sql,
)
from tillroll.oracle.binding_sql import RETAIL, STORE


def statements() -> dict[str, str]:
    retail = (
        sales_sql.BODIES | preparation_sql.BODIES | dashboard_sql.BODIES | checks_sql.BODIES
    )
    store = measures_sql.BODIES | marts_sql.BODIES
    return {key: f"{RETAIL}\n{body}" for key, body in retail.items()} | {
        key: f"{STORE}\n{body}" for key, body in store.items()
    }
