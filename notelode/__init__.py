"""Note chunking, indexing and hybrid retrieval as PySpark DataFrame plans."""

__version__ = "0.1.0"
