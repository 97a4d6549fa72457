"""Operators for large training corpora: secrets, personal data, tokens, quality, duplicates, leakage, HTML.

Each module holds one operator with a general interface; ``queries`` derives the digest
queries from them.  Nothing outside this folder imports it.
"""
