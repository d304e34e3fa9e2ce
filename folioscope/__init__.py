"""Page-evidence analytics on Spark."""
