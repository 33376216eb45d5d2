"""Transcript, timeline and event-log analytics on PySpark DataFrames."""
