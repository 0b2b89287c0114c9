"""tessera: a PySpark-native engine for source-code and text quality analytics."""

__version__ = "1.0.0"
