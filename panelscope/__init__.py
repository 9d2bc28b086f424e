"""Affiliate-attribution and click-fraud analytics on browsing-panel events, as Spark DataFrame transforms."""

__version__ = "0.1.0"
