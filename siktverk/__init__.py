"""Siktverk: document-quality curation on Spark DataFrames."""
