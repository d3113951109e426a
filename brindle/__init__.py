"""Dataset engineering and evaluation as DataFrame transforms on Spark."""
