"""Independent DuckDB SQL for every registered query (the correctness oracle).

inputs are re-derived from ``orders``/``customer``/``supplier``/``events`` in plain SQL and
every rule is restated as SQL. As-of date 1998-08-19 (quarter 1998-07-01 .. 1998-09-30).
"""
from oracle.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
