"""signalbase: a PySpark-native engine for dated text records."""

__version__ = "0.1.0"
