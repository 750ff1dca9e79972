"""A PySpark engine for auditing collections of scanned credentials."""
