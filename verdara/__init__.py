"""Radar and field-measurement analytics as Spark DataFrame operators."""

__all__ = ["functions", "operators", "sources", "plans"]
