"""Similarity analytics on Spark: catalogs of windows, exact and indexed nearest neighbours, evaluation."""
