"""Query catalog (Spark side) and oracle SQL (DuckDB side)."""
