"""caravan: transit analytics and corpus preparation as plain Spark DataFrame operators."""

__version__ = "0.1.0"
