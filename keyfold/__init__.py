"""Typed key-value analytics on Spark: a keyspace as DataFrames, commands as operators over all keys at once."""
