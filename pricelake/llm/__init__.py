"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage; ``queries`` lists what the entry module
registers. Every operator states its method, its scale design and its defined results for nulls,
empty and very long texts, ties, repeated rows and empty tables in its module docstring.
"""
