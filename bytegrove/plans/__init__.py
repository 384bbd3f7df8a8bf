"""Scanners: the set tier and the ordered tier."""
