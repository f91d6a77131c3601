"""Operators that prepare text for training language models, and their registered queries."""

from gleanery.session import self_contained

# Executors get the functions themselves and need no copy of this package.
self_contained(__name__)
