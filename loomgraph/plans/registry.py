"""All queries of the core and their SQL, collected from the modules that define them."""

from __future__ import annotations

from . import catalog_sources, cleaning, explorer, governance, graph, history, mutations, packed_wide_spatial_interval as general, retrieval, scalars, schema_index, search_geo_matching, statistics

MODULES = [general, graph, scalars, statistics, history, search_geo_matching, catalog_sources, schema_index, cleaning, mutations, explorer, retrieval, governance]
FLAGSHIP = graph.QUERIES["bgp_join_group"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in m.ORACLE.items()}
