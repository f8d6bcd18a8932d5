"""Batch text retrieval and question-answering evaluation as lazy Spark plans."""
