"""Adapters of the star-schema tables and the registered queries."""
