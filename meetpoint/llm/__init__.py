"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, and it can be removed as a
whole.  Each operator is a module with a general DataFrame interface;
``queries`` applies the operators to the given tables.
"""
