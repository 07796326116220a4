"""All registered queries of the document operators and their DuckDB equivalents."""

from __future__ import annotations

from quire.operators import compliance, layout, measures, navigation, search, selection, text
from quire.sources import sinks, tables
from quire.streaming import events

FAMILIES = [tables, sinks, text, search, selection, compliance, measures, layout, navigation, events]


def _all():
    return {name: entry for family in FAMILIES for name, entry in family.QUERIES.items()}


def queries():
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark, sf_dir):
    """Search literal terms in all documents and sum up each term."""
    return search.summary(tables.load_corpus(spark, sf_dir), search.term_table(spark))
