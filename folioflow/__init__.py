"""Document-layout analytics as Spark DataFrame plans."""
