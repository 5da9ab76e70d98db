"""churnlens."""
