"""Document analytics and retrieval on Spark: parse, validate, chunk, embed, index and query collections of Markdown and HTML."""

__version__ = "0.1.0"
