"""Operators of pairloom."""
