"""All queries of the library by id, and the oracle's SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgate.plans import programs, relational, textual
from quillgate.plans.dialect import DUCK
from quillgate.sources.model import compose, run_sql

BUILDS = relational.QUERIES | textual.QUERIES
Run = Callable[[SparkSession, str], DataFrame]


def _sql(build) -> Run:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, build)


def queries() -> dict[str, Run]:
    return {name: _sql(build) for name, build in BUILDS.items()} | programs.QUERIES


def oracles() -> dict[str, str]:
    return {name: compose(build(DUCK), DUCK) for name, build in BUILDS.items()} | programs.ORACLES
