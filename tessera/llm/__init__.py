"""Operators for large text corpora: sharding, mixing, search, deduplication, classification, sanitising.

Every operator is a function of DataFrames; the modules ``queries`` and ``oracles`` bind them to the
tables of the driver. Nothing outside this subpackage imports it.
"""
