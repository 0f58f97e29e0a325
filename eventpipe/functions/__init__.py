"""Column functions: each returns a native Spark ``Column`` (JVM side, codegen'd)."""
