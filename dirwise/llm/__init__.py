"""Operators for preparing training data: documents in, documents or decisions out. Nothing else in the library imports this package."""
