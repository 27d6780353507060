"""Part of rankloom."""
