"""Readers and writers for corpora, models and run records."""
