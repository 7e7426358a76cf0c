"""Bindings of the operators to tables, and the catalogue of named queries with their SQL."""
