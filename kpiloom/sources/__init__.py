"""Readers: raw CSV and XML batches, clean datasets, landing folders."""
