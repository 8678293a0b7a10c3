"""User-level entry points, composed of the operators."""
