"""Long-form text, catalogue and pipeline analytics as Spark DataFrame operators."""
