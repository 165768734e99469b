"""Code-health analytics on Spark."""
