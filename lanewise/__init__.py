"""Freight analytics as Spark DataFrame transformations."""
