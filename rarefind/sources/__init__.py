"""Readers, model storage and the shared scratch folder."""
