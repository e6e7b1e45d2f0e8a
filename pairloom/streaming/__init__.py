"""Streaming of pairloom."""
