"""Analytics for agent perception logs, annotations and rule audits on Spark."""
