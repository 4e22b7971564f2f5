"""Corpus-preparation operators for language-model training data.

Each module holds one operator with a general interface (DataFrames in and
out, real texts, spans, files) and the thin registered query on top of it.
Nothing else in the library imports this subpackage.
"""
