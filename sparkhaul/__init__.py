"""Evidence, address and route analytics on Spark."""
