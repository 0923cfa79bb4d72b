"""tidemark: keyed event streams with explicit delivery semantics, analysed on Spark."""

__version__ = "0.1.0"
