"""siftspan: batch text retrieval and evaluation as PySpark DataFrame plans."""

__version__ = "0.1.0"
