"""Readers and writers of build tables."""
