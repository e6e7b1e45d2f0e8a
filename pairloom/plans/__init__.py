"""Plans of pairloom."""
