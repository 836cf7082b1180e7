"""All registered queries of the core, with their DuckDB counterparts."""

from tolqyn.plans import flow_queries, source_queries, store_queries, text_queries, work_queries

MODULES = (store_queries, text_queries, work_queries, source_queries, flow_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
