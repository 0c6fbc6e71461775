"""Readers and writers for the file formats hazard layers arrive in."""
