"""All expected-result SQL by query name."""

from __future__ import annotations

from checks import bronze, clinical, control, idioms, learning, platform, silver
from checks.sqltext import compose

TABLES = {**bronze.TABLES, **silver.TABLES, **platform.TABLES}
SECTIONS = [clinical, learning, control, platform, idioms]


def oracle_sql() -> dict[str, str]:
    return {name: compose(body, TABLES) for section in SECTIONS for name, body in section.SQL.items()}
