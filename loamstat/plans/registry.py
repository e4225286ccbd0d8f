"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from loamstat.plans import files, mining, models, testing

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (testing, mining, models, files):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
