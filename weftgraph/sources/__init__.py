"""Scans and sinks: listings, graph files, delimited instances, label and distance tables, raw bytes."""
