"""Plans: the query catalogue, job entry points and the DuckDB oracle texts."""
