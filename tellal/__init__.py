"""Turkish bulletin extraction and analytics on Spark."""
