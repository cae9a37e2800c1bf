"""Privacy-first web analytics as PySpark DataFrame operators."""
