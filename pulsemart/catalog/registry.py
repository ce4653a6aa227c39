"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsemart.catalog import clinical, control, idioms, learning, platform
from pulsemart.catalog.shape import plain
from pulsemart.plans.health import Health
from pulsemart.plans.logs import Logs

# Sections and the tables their queries are built from.
SECTIONS = [(clinical, Health), (learning, Health), (control, Health), (platform, Logs), (idioms, Health)]


def _registered(build, tables) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(build(tables(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: _registered(build, tables)
        for section, tables in SECTIONS
        for name, build in section.QUERIES.items()
    }
