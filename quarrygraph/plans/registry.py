"""Named queries over the driver tables, with the same results in plain SQL."""

from __future__ import annotations

from . import io_queries, kg_queries, src_queries

QUERIES: dict = {**src_queries.QUERIES, **io_queries.QUERIES, **kg_queries.QUERIES}
ORACLES: dict = {**src_queries.ORACLES, **io_queries.ORACLES, **kg_queries.ORACLES}
FLAGSHIP = "src_relation_histogram"
