"""Terrace: relational analytics over source trees, snapshots and document collections, on PySpark."""
