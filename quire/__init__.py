"""quire: a PySpark-native engine for corpora of interlinked, metadata-bearing pages."""

__version__ = "0.1.0"
