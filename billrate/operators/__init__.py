"""Single-step table operators."""
