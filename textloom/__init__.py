"""Text-archive analytics on Spark."""
