"""Relational building blocks used by the plans."""
