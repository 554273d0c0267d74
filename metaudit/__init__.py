"""Metadata privacy and security audit as Spark DataFrame operators."""
