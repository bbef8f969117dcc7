"""Operators for preparing training data: documents in; scans, groups, samples, shards, bins and token files out."""
