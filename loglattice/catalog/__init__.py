"""Registered queries: each module maps a name to a query, and to the SQL it must agree with."""

from loglattice.catalog import logged, profiles, rows, search, shapes, spans, streams, tables, volumes

MODULES = (search, rows, volumes, profiles, shapes, spans, logged, tables, streams)
