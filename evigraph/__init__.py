"""Evidence-graph curation and analysis as PySpark DataFrame operations."""

__version__ = "0.1.0"
