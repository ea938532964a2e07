"""Column functions: each takes and returns columns, stays in the JVM and can be used in any plan."""
