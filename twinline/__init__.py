"""Spark jobs for preparing and measuring sentence-pair corpora."""
