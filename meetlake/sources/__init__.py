"""Readers and writers for sheets, manifests and canonical result tables."""
