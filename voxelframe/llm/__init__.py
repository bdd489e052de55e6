"""Corpus operators for language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds its query table.
"""
