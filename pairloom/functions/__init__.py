"""Functions of pairloom."""
