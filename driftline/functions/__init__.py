"""Column helpers. Every function takes and returns Spark columns."""
