"""Document memory, retrieval and corpus operators on Apache Spark."""

__version__ = "0.1.0"
