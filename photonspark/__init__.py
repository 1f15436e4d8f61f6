"""photonspark: a PySpark-native analytics engine for hybrid pixel X-ray detector data."""

__version__ = "0.1.0"
