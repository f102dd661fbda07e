"""A PySpark engine for retrieval and grounded answering over document corpora."""

__version__ = "0.1.0"
