"""lakevec: a PySpark-native analytics engine for lake tables, vectors and key-value change logs."""

__version__ = "0.1.0"
