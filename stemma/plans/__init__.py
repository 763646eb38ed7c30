"""The stored graph, its query language, and the catalogue of queries."""
