"""A small causal sequence model in NumPy, scored inside Arrow batches."""
