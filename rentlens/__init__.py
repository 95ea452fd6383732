"""Rental-listing and commute analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
