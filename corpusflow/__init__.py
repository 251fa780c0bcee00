"""corpusflow: corpus building and retrieval as PySpark DataFrame jobs."""
