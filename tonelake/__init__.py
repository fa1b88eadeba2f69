"""Review-sentiment analytics as Spark DataFrame operators."""
