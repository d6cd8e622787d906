"""Provenance analytics on Spark."""
