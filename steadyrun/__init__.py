"""Repeated-run evaluation analytics as Spark DataFrame operators."""
