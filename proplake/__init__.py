"""Listing analytics on Spark DataFrames: extraction, enrichment, gating, merging, matching, scoring and reports."""
