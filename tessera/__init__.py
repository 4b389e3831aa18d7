"""A relational, vector and corpus analytics engine written as DataFrame and SQL plans."""

__version__ = "0.1.0"
