"""Known-name matching on Spark."""
