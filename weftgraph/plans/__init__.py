"""Whole programs: each chains operators from a scan to a sink."""
