"""Corpus operators for language-model training data.

Each module holds one operator with its general interface; ``registry`` lists
the queries built on them.  Nothing outside this subpackage imports it.
"""
