"""Readers and writers of string collections."""
