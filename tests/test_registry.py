"""Every query has SQL, and a spread of them agrees with it on the small data set."""

from __future__ import annotations

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL

CHECKED = ["t1_dim_patient", "t7_fact_rehab_session", "t9_patient_history", "m1_rehab_program_summary",
           "m5_cms_cardiac_rehab", "d15_comorbidity_pairs", "l1_patient_clinical_features", "l6_cardiac_rehab_features",
           "a15_user_risk_score", "o16_query_type_summary", "x1_note_summaries", "x4_note_entities",
           "y2_metrics_across", "n7_bound_policies_readonly", "z1_failure_spikes", "q9_key_checks", "s3_insert_select_defaults"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in pathlib.Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_queries_and_sql_have_the_same_names():
    sql = entry_module.oracle_sql()
    corpus = entry_module.corpus.queries() if entry_module.corpus else {}
    queries = set(entry_module.queries()) - set(corpus) - {"pipeline"}
    assert queries == set(sql) - set(corpus) - {"pipeline"} and len(queries) > 250


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(str([clean(row[i]) for i in order]) for row in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    frame = entry_module.queries()[name](spark, SMALL)
    expected = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(frame.columns) == sorted(names)
    assert _rows(frame.columns, frame.collect()) == _rows(names, expected.fetchall())


def test_platform_health_counts_a_view_once(spark, con):
    frame = entry_module.queries()["q21_platform_health"](spark, SMALL)
    sql = con.execute(entry_module.oracle_sql()["q21_platform_health"])
    names = [d[0] for d in sql.description]
    rows = sql.fetchall()
    assert _rows(frame.columns, frame.collect()) == _rows(names, rows)
    assert {r[names.index("actual")] for r in rows if "08. Analytics Views" in r} == {9}


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
