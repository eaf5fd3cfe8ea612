"""Column functions: each takes and returns columns and stays inside Spark's generated code."""
