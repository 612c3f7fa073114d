"""Reference answers in DuckDB SQL, written independently of the Spark plans."""

from oracles.build import oracle_queries

__all__ = ["oracle_queries"]
