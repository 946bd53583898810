"""Earthquake catalogues on Spark: ingest, cleanse, roll up, serve."""
