"""Sedra: incremental aggregation, relational queries and small classifiers as Spark plans."""
