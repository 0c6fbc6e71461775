"""Geospatial peril rating as Spark DataFrame operators."""
