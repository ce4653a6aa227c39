"""The stored build gives the same marts as the lazy one, and its joins need no exchange."""

from __future__ import annotations

from pulsemart.plans import gold
from pulsemart.plans.health import Health
from pulsemart.plans.medallion import build_gold, build_silver


def test_stored_build(spark, sf_dir, tmp_path):
    health = Health(spark, sf_dir)
    silver = build_silver(health, str(tmp_path / "silver"), "built", 4)
    marts = build_gold(silver, health.raw_claims, str(tmp_path / "gold"), health.as_of)
    lazy = gold.cms_cardiac_rehab(health.fact_rehab_referral, health.fact_rehab_session)
    columns = sorted(lazy.columns)
    assert sorted(map(str, marts["cms_cardiac_rehab"].select(columns).collect())) == sorted(
        map(str, lazy.select(columns).collect())
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = silver["fact_encounter"].join(silver["dim_patient"], "patient_id").groupBy("patient_id").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    for name in silver:
        spark.sql(f"DROP TABLE built_{name}")
