"""Operators for language-model training data made of code, questions and documents.

Nothing outside this subpackage imports it.
"""
