"""Column-expression helpers: built-in Spark SQL functions only, no Python on the row path."""
