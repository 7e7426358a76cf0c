"""Readers and writers of the formats the engine knows."""
