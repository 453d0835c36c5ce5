"""Operators for building language-model training corpora.

Everything in this subpackage stands alone: the rest of the library never imports it, and it
imports nothing from the rest.
"""
