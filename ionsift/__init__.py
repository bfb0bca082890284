"""Retrieval, ranking and fusion over spectra and structure catalogs, on Spark."""
