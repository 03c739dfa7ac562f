"""Event-graph analytics on Spark."""
