"""Readers that map the driver tables and page files onto the model tables, and sinks."""
