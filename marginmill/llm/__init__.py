"""Operators for training-data pipelines: text identity, safety, quality, packing and archives."""
