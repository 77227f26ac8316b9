"""Indicator extraction and data quality on Spark."""
