"""Private rewriting of text collections, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
