"""Spark building blocks for transaction tables."""
