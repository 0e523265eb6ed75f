"""Operators of a training-data pipeline: mixing, packing, chat, near-duplicates, language, search, pages, archives.

Nothing else in the library imports this package.  ``queries`` registers one query per operator.
"""
