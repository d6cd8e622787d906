"""Operators on provenance and conversation tables."""
