"""Fleet-ping analytics on Spark."""
