"""Directory intelligence on Spark: table-in / table-out operators."""

__version__ = "0.1.0"
