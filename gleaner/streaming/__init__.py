"""Incremental variants of the batch jobs."""
