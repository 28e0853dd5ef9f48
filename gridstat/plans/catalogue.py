"""The catalogue: every query of the library and its SQL, by name."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from gridstat.plans import registry

MODULES = ["descriptive", "sequence", "grid", "matrix", "selection", "dynamics", "extras", "codes"]
for _m in MODULES:
    importlib.import_module(f"gridstat.plans.{_m}")


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["growth_summary"](spark, sf_dir)
