"""Preparation, enrichment and audit of labelled text data sets on Spark."""
