"""Composed analyses: shared intermediate frames, the registered queries, the
DuckDB oracle SQL, and the six reports."""
