"""Change-history risk analytics as PySpark DataFrame operators."""
