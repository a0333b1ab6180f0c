"""tidemark: Spark-native evidence triage over semi-structured records."""

__version__ = "0.1.0"
