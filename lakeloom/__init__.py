"""Analytics on large file collections and their metadata, and on text corpora, with PySpark."""
