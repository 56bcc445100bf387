"""Versioned-document analytics expressed as Spark DataFrame transformations."""
