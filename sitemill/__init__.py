"""Citation-site analytics as Spark DataFrame plans."""
