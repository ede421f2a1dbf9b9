"""All queries of the engine's own operators."""

from kerbline.queries import fixtures, files, judged, records, scalars, space, streams  # noqa: F401

MODULES = [scalars, records, space, judged, streams, files]
QUERIES: dict = {}
SQL: dict = {}
for _m in MODULES:
    QUERIES |= _m.reg.queries
    SQL |= _m.reg.sql
