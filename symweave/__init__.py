"""symweave: a Spark engine for indexing and querying code and text at symbol granularity."""

__version__ = "0.1.0"
