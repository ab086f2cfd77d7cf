"""Operators of a training-data pipeline: duplicates, quality, tokens, leaks, secrets, archives.

Nothing else in the library imports this package.
"""
