"""Operators for training-data pipelines: mixing, filtering, deduplication, search and scoring of documents."""
