"""Tiny text helpers for writing the expected-result SQL."""

from __future__ import annotations

import re

CLINICAL_DAY = "TIMESTAMP '2002-01-01 00:00:00'"
LOG_DAY = "TIMESTAMP '2024-01-31 00:00:00'"


def pick(values: list[str], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def pad(prefix: str, key: str, width: int = 12) -> str:
    return f"('{prefix}' || lpad(CAST({key} AS VARCHAR), {width}, '0'))"


def r(value: str, places: int) -> str:
    """Half-up rounding of the printed value of a double."""
    return f"CAST(round(CAST(CAST(({value}) AS VARCHAR) AS DECIMAL(38,20)), {places}) AS DOUBLE)"


def values(rows: list[tuple], columns: list[str]) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})"


def exact(value: str, places: int = 2) -> str:
    """An exact number printed with all its places."""
    return f"CAST(CAST({value} AS DECIMAL(38,{places})) AS VARCHAR)"


def key(business_id: str) -> str:
    """Surrogate key: the first 60 bits of the digest of the id."""
    return f"CAST('0x' || left(md5({business_id}), 15) AS BIGINT)"


def printed(moment: str) -> str:
    """A time as text to the microsecond."""
    return f"strftime({moment}, '%Y-%m-%d %H:%M:%S.%f')"


def weeks(start: str, end: str) -> str:
    return (
        f"CAST((CAST(date_trunc('week', {end}) AS DATE) - CAST(date_trunc('week', {start}) AS DATE)) / 7 AS BIGINT)"
    )


def compose(body: str, tables: dict[str, str]) -> str:
    """Prefix ``body`` with the named tables it needs, directly or through other tables."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if name in tables and name not in ordered:
                need(tables[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    heads = ",\n".join(f"{name} AS (\n{tables[name].strip()}\n)" for name in ordered)
    lead = body.strip()
    if lead.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{lead[15:]}"
    if lead.upper().startswith("WITH "):
        return f"WITH {heads},\n{lead[5:]}"
    return f"WITH {heads}\n{lead}"
