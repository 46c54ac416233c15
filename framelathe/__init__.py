"""framelathe: a PySpark-native engine for episode quality gates, curation and corpus preparation."""

__version__ = "0.1.0"
