"""plantlens: emissions and operations analytics expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
