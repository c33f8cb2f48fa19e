"""Readers, writers and keyed collections."""
