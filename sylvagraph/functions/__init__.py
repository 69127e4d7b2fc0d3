"""Kinds, predicates and scalar functions."""
