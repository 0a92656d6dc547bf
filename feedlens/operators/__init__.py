"""Operators over the signal table: filters, cleaning, metrics, facets, profiles."""
