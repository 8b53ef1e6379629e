"""A PySpark engine for property graphs made from tables and texts."""
