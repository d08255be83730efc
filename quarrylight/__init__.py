"""Quarrylight: entity-intelligence and retrieval analytics as PySpark DataFrame stages."""

__version__ = "0.1.0"
