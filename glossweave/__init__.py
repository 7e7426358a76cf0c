"""A PySpark engine for linguistic analytics; see README.md."""
