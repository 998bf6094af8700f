"""Detection, redaction and corpus analytics over text columns on Spark."""

__version__ = "0.1.0"
