"""penawar: matching free-text order lines to a catalog and pricing them, on Spark."""

__version__ = "0.1.0"
