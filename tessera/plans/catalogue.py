"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import batched, casework, core, curation, lexical, queues, resolver, states, streams, upkeep

MODULES = [casework, core, states, resolver, curation, upkeep, streams, lexical, batched, queues]


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.ORACLE
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.flagship(spark, sf_dir)
