"""Document-catalog analytics on Spark."""
