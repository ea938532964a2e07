"""DataFrame operators: each takes and returns data frames."""
