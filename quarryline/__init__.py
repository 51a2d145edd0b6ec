"""Spark jobs for retrieval over document collections and for building training corpora."""
