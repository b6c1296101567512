"""Sequence analytics on Spark: readers, sequence functions, cloning and folding operators."""
