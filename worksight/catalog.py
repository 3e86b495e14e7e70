"""Query key -> callable and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worksight.plans import archive, domain, forms, ledger, records, relational, rules, signals, site

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (rules, relational, records, signals, domain, ledger, archive, site, forms):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
