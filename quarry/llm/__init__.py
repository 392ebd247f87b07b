"""Operators for large text corpora (PII, licences, language models, near-duplicates, mixing, ...).

Nothing else in the library imports this subpackage.
"""
