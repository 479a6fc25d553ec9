"""Typed knowledge-graph analytics on Spark DataFrames.

Every operator maps DataFrames to DataFrames, takes ``as_of`` explicitly and
never mutates: a "write" is returned as the delta or the new snapshot.
"""
