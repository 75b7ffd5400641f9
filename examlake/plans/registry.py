"""All registered queries with their DuckDB oracles, gathered from the query modules."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("examlake.plans.bank_queries", "examlake.plans.paper_queries", "examlake.plans.extract_queries", "examlake.plans.tenant_queries", "examlake.plans.report_queries", "examlake.plans.job_queries", "examlake.plans.graph_queries")


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in import_module(m).QUERIES.items() if sql}
