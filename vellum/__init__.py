"""Document screening and corpus preparation on Spark."""
