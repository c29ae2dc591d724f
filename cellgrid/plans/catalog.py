"""The registered queries of the relational part: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from cellgrid.plans import grid_queries, table_queries

QUERIES: dict = grid_queries.QUERIES | table_queries.QUERIES
SQL: dict = grid_queries.SQL | table_queries.SQL
