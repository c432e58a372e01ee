"""Service-queue analytics on Spark: cleaning, features, allocation, reports and models."""

__version__ = "0.1.0"
