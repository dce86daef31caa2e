"""touchline: event-sequence analytics for football data, written as plain Spark DataFrame operators."""

__version__ = "0.1.0"
