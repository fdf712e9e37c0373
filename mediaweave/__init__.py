"""Media-library analytics on Spark."""
