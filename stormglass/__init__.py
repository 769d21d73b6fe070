"""stormglass: a Spark-first engine for time-ordered streams of short posts."""

__version__ = "0.1.0"
