"""Lodestone: hybrid search and catalogue curation as lazy PySpark plans."""
