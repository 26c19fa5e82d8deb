"""Operators of a training-data pipeline: tokens, licences, duplicates, leaks, languages, quality and personal data.

Nothing else in the library imports this package.
"""
