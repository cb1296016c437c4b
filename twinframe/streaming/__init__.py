"""Comparison of arriving batches with a reference table (an extension; see README)."""
