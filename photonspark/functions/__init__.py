"""Part of photonspark."""
