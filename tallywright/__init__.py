"""Contribution analytics as Spark DataFrame operators."""
