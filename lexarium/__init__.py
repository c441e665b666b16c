"""lexarium: a PySpark-native engine for document-corpus retrieval and analytics."""

__version__ = "0.1.0"
