"""Parsers and writers of single documents: plain Python, run inside Arrow batches by ``operators``."""
