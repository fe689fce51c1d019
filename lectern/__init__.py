"""Lectern: document-study analytics expressed as Spark DataFrame plans."""
