"""Scanning what arrives in a folder."""
