"""Clinical-text and hospital-warehouse analytics as composable Spark DataFrame operators."""

__version__ = "0.1.0"
