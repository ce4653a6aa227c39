"""A small metric layer: named dimensions, time dimensions, measures and relationships."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

AGE_GROUP = (
    "CASE WHEN age < 45 THEN '<45' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' "
    "WHEN age < 75 THEN '65-74' ELSE '75+' END"
)

# The metric model.
MODEL = {
    "dim_patient": {
        "dimensions": {"patient_id": "patient_id", "gender": "gender", "ethnicity": "ethnicity", "age_group": AGE_GROUP},
        "time_dimensions": {},
        "measures": {"patient_count": "count(DISTINCT patient_id)", "average_age": "avg(age)"},
    },
    "fact_rehab_session": {
        "dimensions": {"session_id": "session_id", "modality": "modality", "safety_flag": "safety_flag",
                       "therapist": "therapist"},
        "time_dimensions": {"session_date": "session_date"},
        "measures": {
            "total_sessions": "count(*)", "avg_peak_hr": "avg(peak_hr)", "avg_rpe": "avg(rpe_peak)",
            "avg_duration": "avg(duration_minutes)",
            "safety_incident_count": "sum(CASE WHEN safety_flag THEN 1 ELSE 0 END)",
            "early_termination_count": "sum(CASE WHEN exercise_terminated_early THEN 1 ELSE 0 END)",
            "total_ecg_minutes": "sum(ecg_monitor_minutes)", "avg_hrr_percent": "avg(achieved_hrr_percent)",
        },
    },
    "fact_rehab_referral": {
        "dimensions": {"referral_id": "referral_id", "qualifying_diagnosis": "qualifying_diagnosis",
                       "risk_category": "computed_risk"},
        "time_dimensions": {"referral_date": "referral_date"},
        "measures": {
            "referral_count": "count(DISTINCT referral_id)", "avg_lvef": "avg(lvef_percent)",
            "avg_days_to_referral": "avg(days_event_to_referral)",
        },
    },
    "fact_rehab_outcome": {
        "dimensions": {"measurement_point": "measurement_point", "depression_severity": "depression_severity"},
        "time_dimensions": {"measurement_date": "measurement_date"},
        "measures": {
            "avg_6mwt": "avg(six_min_walk_meters)", "avg_peak_mets": "avg(peak_mets)", "avg_phq9": "avg(phq9_score)",
            "avg_bmi": "avg(bmi)",
        },
    },
}

# Many-to-one relationships: table, the table it leads to, and their key, which is unique there.
RELATIONS = [
    ("fact_rehab_session", "fact_rehab_referral", "referral_id"),
    ("fact_rehab_outcome", "fact_rehab_referral", "referral_id"),
    ("fact_rehab_referral", "dim_patient", "patient_id"),
]


def metrics(
    tables: dict[str, DataFrame], table: str, measures: list[str], dimensions: list[str] = (),
    grain: tuple[str, str] | None = None, where: str | None = None,
) -> DataFrame:
    """Measures of one table by its dimensions and, optionally, (time dimension, grain)."""
    spec, df = MODEL[table], tables[table]
    if where:
        df = df.filter(where)
    keys = [F.expr(spec["dimensions"][d]).alias(d) for d in dimensions]
    if grain:
        name, unit = grain
        keys.append(F.date_trunc(unit, F.expr(spec["time_dimensions"][name])).cast("date").alias(name))
    return df.groupBy(*keys).agg(*[F.expr(spec["measures"][m]).alias(m) for m in measures])


def path(table: str, owner: str, relations: list[tuple[str, str, str]] = RELATIONS) -> list[tuple[str, str]]:
    """The shortest way from ``table`` to ``owner`` along many-to-one relationships: (table reached, key) per step."""
    ways, seen = [(table, [])], {table}
    while ways:
        at, steps = ways.pop(0)
        if at == owner:
            return steps
        for child, parent, key in relations:
            if child == at and parent not in seen:
                seen.add(parent)
                ways.append((parent, [*steps, (parent, key)]))
    raise ValueError(f"{table} does not lead to {owner}")


class Partial:
    """Measures as states that add up: kept per key while they are carried from table to table.

    Sums and counts add up as they are, a mean is a sum and a count. What is counted distinct stays a key
    of the state until the end.
    """

    FORM = re.compile(r"(count|sum|avg)\((DISTINCT )?(.*)\)$", re.S)

    def __init__(self, measures: dict[str, str]):
        self.first, self.last, self.distinct = {}, {}, {}
        for name, text in measures.items():
            found = self.FORM.match(text)
            if not found:
                raise ValueError(f"no state is known for {text}")
            function, once, value = found.groups()
            if once and function == "count":
                column = f"_once_{len(self.distinct)}"
                self.distinct[column] = F.expr(value)
                self.last[name] = F.countDistinct(column)
            elif function == "count":
                self.first[f"_n_{name}"] = F.count("*") if value == "*" else F.count(F.expr(value))
                self.last[name] = F.sum(f"_n_{name}")
            else:
                self.first[f"_s_{name}"] = F.sum(F.expr(value))
                self.last[name] = F.sum(f"_s_{name}")
                if function == "avg":
                    self.first[f"_n_{name}"] = F.count(F.expr(value))
                    self.last[name] = F.sum(f"_s_{name}") / F.nullif(F.sum(f"_n_{name}"), F.lit(0))

    def begin(self, df: DataFrame, key: str) -> DataFrame:
        states = [column.alias(name) for name, column in self.first.items()] or [F.count("*").alias("_rows")]
        return df.groupBy(key, *[c.alias(n) for n, c in self.distinct.items()]).agg(*states)

    def move(self, state: DataFrame, key: str) -> DataFrame:
        """The same states added up by another key that has been joined to them."""
        kept = [c for c in state.columns if c.startswith(("_n_", "_s_"))] or ["_rows"]
        return state.groupBy(key, *self.distinct).agg(*[F.sum(c).alias(c) for c in kept])

    def end(self, state: DataFrame, key: str) -> DataFrame:
        return state.groupBy(key).agg(*[column.alias(name) for name, column in self.last.items()])


def metrics_across(
    tables: dict[str, DataFrame], dimension: tuple[str, str], measures: dict[str, list[str]],
    model: dict[str, dict] = MODEL, relations: list[tuple[str, str, str]] = RELATIONS,
) -> DataFrame:
    """Measures of several tables by one dimension of a table they all lead to.

    Each fact is added up by its first key before any join; the states are carried along many-to-one keys and
    added up again after each step. Only the results are joined, so no fact is counted twice through another.
    """
    owner, name = dimension
    value = F.expr(model[owner]["dimensions"][name])
    parts = [tables[owner].select(value.alias(name)).distinct()]
    for table, wanted in measures.items():
        partial = Partial({m: model[table]["measures"][m] for m in wanted})
        steps = path(table, owner, relations)
        if not steps:
            parts.append(partial.end(partial.begin(tables[table].withColumn("_dim", value), "_dim"), "_dim").withColumnRenamed("_dim", name))
            continue
        state = partial.begin(tables[table], steps[0][1])
        for (reached, key), (_, onward) in zip(steps, steps[1:]):
            state = partial.move(state.join(tables[reached].select(key, onward), key), onward)
        last = steps[-1][1]
        ends = state.join(tables[owner].select(last, value.alias("_dim")), last)
        parts.append(partial.end(ends, "_dim").withColumnRenamed("_dim", name))
    return reduce(lambda a, b: _left_null_safe(a, b, name), parts)


def _left_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    other = right.withColumnRenamed(key, "_other")
    return left.join(other, F.col(key).eqNullSafe(F.col("_other")), "left").drop("_other")
