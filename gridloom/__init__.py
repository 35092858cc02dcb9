"""Spark-native 2-D pattern detection over sparse contact matrices."""

__version__ = "0.1.0"
