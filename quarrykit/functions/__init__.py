"""Column functions: text, code and numeric helpers built from Spark expressions or Arrow batches."""
