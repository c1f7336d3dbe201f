"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers the thin query of each.
"""
