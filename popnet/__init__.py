"""popnet: population-weighted network inference as PySpark DataFrame plans."""

__version__ = "0.1.0"
