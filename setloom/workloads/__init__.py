"""Queries over the test tables, each with the SQL that must give the same rows."""

from . import (
    claims_queries, dispersion_queries, enrichment_queries, interval_queries, linking_queries, matrix_queries, set_queries, source_queries, text_queries,
)

_MODULES = (interval_queries, matrix_queries, dispersion_queries, set_queries, enrichment_queries, text_queries, claims_queries, source_queries, linking_queries)


def all_queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
