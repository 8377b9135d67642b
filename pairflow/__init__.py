"""pairflow: preparation, routing, scoring and evaluation of large tables of text pairs on Spark."""

__version__ = "0.1.0"
