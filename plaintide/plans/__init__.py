"""Composite reports, and the catalog of named queries over the driver tables."""
