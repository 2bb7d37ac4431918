"""All queries of the core."""

from __future__ import annotations

from quillspark.plans import formats, judging, records, references, relational, samples, series, sources, texts

MODULES = (references, series, relational, texts, samples, sources, records, formats, judging)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
