"""Jagged event analytics on Apache Spark: one row per event, banks as arrays of structs."""

__version__ = "0.1.0"
