"""Monitoring of short texts on Spark: keyword tagging, cleaning, relevance classification, extraction."""
