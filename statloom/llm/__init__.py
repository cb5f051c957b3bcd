"""Operators for preparing texts for language models; nothing else in the library imports this package."""
