"""A PySpark engine for music-credit graphs."""
