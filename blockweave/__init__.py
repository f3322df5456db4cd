"""blockweave: a PySpark-native engine for block-oriented, lossless byte-data processing."""

__version__ = "0.1.0"
