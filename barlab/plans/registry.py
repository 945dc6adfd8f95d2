"""Registered queries of the bar library and their DuckDB SQL."""

from barlab.plans import audit_queries, catalog_queries, experiment_queries, feature_queries, misc_queries, portfolio_queries, report_queries, trade_queries

FLAGSHIP = "w01_bar_features"
_PARTS = (feature_queries, trade_queries, audit_queries, portfolio_queries, misc_queries, catalog_queries, report_queries, experiment_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.Q.items()}
ORACLE_SQL: dict = {k: v for p in _PARTS for k, v in p.S.items()}
