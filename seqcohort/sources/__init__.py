"""Readers and writers for alignments and result tables."""
