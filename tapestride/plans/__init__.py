"""The named queries of the engine's own operators."""

from . import catalog2, catalog3, catalog4, catalog5, catalog6, catalog7, catalog8, streams
from .catalog import QUERIES, SQL

assert catalog2 and catalog3 and catalog4 and catalog5 and catalog6 and catalog7 and catalog8 and streams  # imported for their registrations


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
