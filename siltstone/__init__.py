"""A Spark-first reader for versioned Parquet tables with a transaction log."""

__version__ = "0.1.0"
