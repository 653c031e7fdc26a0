"""Collects the named queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rotogrid.plans import further, ingest, matching, spectra, streams, structures, volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (ingest, matching, volumes, structures, further, spectra, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
