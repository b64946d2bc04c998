"""Query catalog (registered queries and their DuckDB twins)."""
