"""DataFrame operators: each takes tables and returns a table."""
