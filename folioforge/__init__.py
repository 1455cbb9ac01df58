"""folioforge: a Spark-first engine for document retrieval, its evaluation and its upkeep."""

__version__ = "0.1.0"
