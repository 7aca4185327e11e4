"""Dataflow graphs, record schemas and row expressions bound to lazy Spark DataFrames."""
