"""Entity resolution, field resolution and sync audit as PySpark DataFrame operators."""

__version__ = "0.1.0"
