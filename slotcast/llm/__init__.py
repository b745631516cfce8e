"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; :mod:`slotcast.llm.queries` registers one query
for each.
"""
