"""Column functions: each takes and returns Columns, all evaluated in the JVM."""
