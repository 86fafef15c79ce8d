"""A PySpark-native entity-resolution engine."""

__version__ = "0.1.0"
