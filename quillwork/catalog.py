"""Every query of the library, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import attention, chapters, glossary, governance, graph, ledger, lexical, matching, merging, messages, pages, quality, reading, reads, records, review, selection, senses, upkeep, usage, views, wording
from .sources import metering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for module in (attention, chapters, glossary, governance, graph, ledger, lexical, matching, merging, messages, metering, pages, quality, reading, reads, records, review, selection, senses, upkeep, usage, views, wording):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
