"""Relational and text operators over logical tables."""
