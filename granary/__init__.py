"""Spark jobs that build, govern, search and measure a text knowledge base."""
