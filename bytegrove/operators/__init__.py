"""Filters, identifiers, analyzers, extractors and ready-made plugins."""
