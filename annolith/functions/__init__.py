"""Part of annolith."""
